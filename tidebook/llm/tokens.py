"""Byte-level BPE by a public vocabulary file. The file's place is a parameter; nothing is trained or copied."""

from __future__ import annotations

import functools
import json

#: The published split pattern of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in such files: printable Latin-1 stands for itself, the rest for code points from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoding(path: str, added: bool = False):
    """The file's vocabulary as a fast encoder with the same ids. Its encode_ordinary takes the added tokens' strings in a text as ordinary text; with added, its
    encode(text, allowed_special="all") gives them their own ids, as the tokenizers library does."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if added or t.get("special")}
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special if added else {})
