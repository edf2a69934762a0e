"""Token ids of a public byte-level BPE vocabulary, with a bounded cache of word pieces."""

from __future__ import annotations

import base64
import re
import sys
from array import array

import public_tokenizers
import tiktoken

# White space other than the space and the line feed (Unicode), and the separators 1C to 1F.
_ODD_CODES = (0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_ODD_SPACE = re.compile("[" + "".join(map(chr, _ODD_CODES)) + "]").search
_CACHE_ENTRIES = 400_000
_LINE_FEED = "\n"


def load_encoding(name: str = "byte_bpe_50k") -> tiktoken.Encoding:
    """The vocabulary as ranks; it gives the same ids as the JSON file of the same name."""
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class _Pieces(dict):
    """prefix + piece -> little-endian ids; past the bound new pieces are encoded and not stored."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self._encode, self._prefix = encode, prefix

    def __missing__(self, piece: str) -> bytes:
        ids = _packed(self._encode(self._prefix + piece))
        if len(self) < _CACHE_ENTRIES and len(piece) <= 32:
            self[piece] = ids
        return ids


class Tokenizer:
    """Ids as little-endian unsigned 32-bit bytes.

    The pre-tokenizer never joins what stands on two sides of white space, except that one space
    leads the word behind it. Texts whose white space is single spaces and line feeds between
    words are therefore the concatenation of cached pieces; all others go to the encoder whole.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        self._encoding = load_encoding(name)
        self._special = "<|endoftext|>"
        self._plain = self._encoding.encode_ordinary
        self._first, self._spaced = _Pieces(self._plain, ""), _Pieces(self._plain, " ")
        self._feed = _packed(self._plain(_LINE_FEED))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self._special in text:  # the JSON file's tokenizer reads the special token's string as that token
            return _packed(self._encoding.encode(text, allowed_special="all"))
        if _ODD_SPACE(text) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return _packed(self._plain(text))
        first, spaced, lines = self._first, self._spaced.__getitem__, []
        for line in text.split(_LINE_FEED):
            head, *rest = line.split(" ")
            lines.append(first[head] + b"".join(map(spaced, rest)))
        return self._feed.join(lines)


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(name: str = "byte_bpe_50k") -> Tokenizer:
    """One tokenizer for each Python worker."""
    if name not in _LOADED:
        _LOADED[name] = Tokenizer(name)
    return _LOADED[name]
