"""Byte-level BPE ids inside tasks."""

from __future__ import annotations

import base64
import re
from array import array
from functools import cache

import public_tokenizers
import tiktoken

#: Chunks whose ids a Python worker remembers, the first that it meets (about 60 MB).
REMEMBERED = 250_000
#: The special token whose string in a text stands for one id, as the tokenizer file has it.
SPECIAL = "<|endoftext|>"
#: Where a text may be cut, and what a text must not hold for every one of its spaces to be such a place.
CUT, BLANKS = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Chunks(dict):
    """Chunk, without the space before it, to the bytes of its ids (little-endian unsigned 32 bits)."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = _packed(self.encode(" " + chunk))
        if len(self) < REMEMBERED:
            self[chunk] = ids
        return ids


@cache
def _loaded(name: str) -> tuple[tiktoken.Encoding, _Chunks]:
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    coder = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return coder, _Chunks(coder.encode_ordinary)


def id_bytes(text: str | None, name: str = "byte_bpe_50k", special: bool = True) -> bytes:
    """The ids of text as little-endian unsigned 32-bit numbers; null and empty: none.

    special: the special token's string in a text stands for its one id; without, it is ordinary text.

    A space before a character that is no white space (in Unicode's sense) always begins a piece of the
    pre-tokenizer, so text is cut there, and only there, and equal chunks are encoded once.
    The rank file holds the same vocabulary as ``byte_bpe_50k.json``; the tests hold both against each other.
    """
    if not text:
        return b""
    coder, chunks = _loaded(name)
    if special and SPECIAL in text:
        return _packed(coder.encode(text, allowed_special="all"))
    first, *rest = CUT.split(text) if BLANKS.search(text) else text.split(" ")
    return _packed(coder.encode_ordinary(first)) + b"".join(map(chunks.__getitem__, rest))
