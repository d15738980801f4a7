"""DataFrame transforms; one module per family of operators."""
