"""Area statistics on PySpark: cube scans, indicator calculations, spatial joins,
register profiles, outlooks, peer ranks, exports and reconciliation checks,
all as DataFrame transforms."""
