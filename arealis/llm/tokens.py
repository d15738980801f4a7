"""Token ids of whole texts by the public byte-level BPE vocabulary.

Ids are those that ``tokenizers`` gives for ``byte_bpe_50k.json`` with ``add_special_tokens=False``: none are put around a
text, but the file's added token ``<|endoftext|>`` inside a text is its one id, and the text is cut there before anything
else. All other ids are computed from the same vocabulary's ranks, which is several times faster. Ids come as
little-endian unsigned 32-bit integers in bytes.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable

VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: the vocabulary's split pattern where a text has neither an apostrophe nor two
#: white spaces in a row; the other branches of the whole pattern can't match there.
_PLAIN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_BRANCHES = re.compile(r"'|\s\s")

#: The vocabulary's one added token; its id follows those of the ranks. It is looked for in the text as it is.
ADDED = "<|endoftext|>"

_encoders: dict[str, Callable[[list[str | None]], list[bytes]]] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Callable[[list[str | None]], list[bytes]]:
    """``encode(texts) -> ids of each``, one per process and vocabulary; a null text is empty and the added token ordinary text."""
    if path in _encoders:
        return _encoders[path]
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    whole, plain = (
        tiktoken.Encoding("corpus", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (PATTERN, _PLAIN)
    )

    def encode(texts: list[str | None]) -> list[bytes]:
        return [array("I", (whole if _BRANCHES.search(t) else plain)(t)).tobytes() if t else b"" for t in texts]

    _encoders[path] = encode
    return encode


def text_encoder(path: str) -> Callable[[list[str | None]], list[bytes]]:
    """As ``encoder``, with the added token's id wherever it stands in a text."""
    ordinary = encoder(path)
    with open(path, "rb") as lines:
        added = array("I", [1 + max(int(x.split()[1]) for x in lines)]).tobytes()

    def encode(texts: list[str | None]) -> list[bytes]:
        return [added.join(ordinary(t.split(ADDED))) if t and ADDED in t else ordinary([t])[0] for t in texts]

    return encode
