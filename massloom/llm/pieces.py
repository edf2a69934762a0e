"""SentencePiece encoding and decoding of a merge-type (BPE) vocabulary by a table of prefixes.

Every prefix of a text has one last token: the encoding of a prefix is the beginning of a longer
prefix's encoding wherever that one has a token boundary, and a sequence of tokens is an encoding
exactly if each two neighbours are the encoding of their own concatenation. So the table is filled
from the left: an automaton over all pieces names the pieces that end at a place, and the one that
is compatible with the last token of what lies before it is that place's last token. The ids are
then read off backwards. Time and memory grow with the text, not with its square.

Texts are cut where no piece of the vocabulary goes across (before blanks, between letters and
digits, at characters that no piece has), as these parts are encoded alike wherever they stand;
the ids of short parts are remembered within a bound.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from pathlib import Path

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

BLANK = "▁"
ROWS = 256  # documents of one output batch
_ENTRIES, _PAIRS, _LONGEST = 300_000, 500_000, 32  # remembered words, parts and pairs at most, and the longest of these strings
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # kinds of pieces in the model's file


def _cutter(pieces: Iterable[str], characters: list[str]) -> re.Pattern:
    """A pattern whose matches are the segments that no piece goes across: blanks and then characters of one class.

    Two characters are of one class if they, or others between them, are neighbours in a piece.
    """
    above = {c: c for c in characters}

    def top(c: str) -> str:
        while above[c] != c:
            above[c] = above[above[c]]
            c = above[c]
        return c

    for a, b in {pair for piece in pieces for pair in zip(piece, piece[1:], strict=False)}:
        if b == BLANK and a != BLANK:  # a piece goes on over a blank
            raise ValueError("pieces with a blank behind another character are not supported")
        if a != BLANK:
            above[top(a)] = top(b)
    classes: dict[str, list[str]] = {}
    for c in characters:
        if c != BLANK:
            classes.setdefault(top(c), []).append(re.escape(c))
    several = sorted((m for m in classes.values() if len(m) > 1), key=len, reverse=True)
    single = "".join(m[0] for m in classes.values() if len(m) == 1)
    kinds = [f"[{''.join(m)}]+" for m in several] + ([f"[{single}]"] if single else [])
    known = "".join(re.escape(c) for c in characters)
    return re.compile("|".join([f"{BLANK}*(?:{'|'.join(kinds)})", f"{BLANK}+", f"[^{known}{BLANK}]+"] if kinds else [f"{BLANK}+", f"[^{BLANK}]+"]))


class Vocabulary:
    """The pieces of a model with byte fallback, identity normalisation and a blank set before each text."""

    def __init__(self, model: str | Path):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(Path(model).read_bytes())
        normal = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if (proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback) != (2, True) or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("a BPE model with byte fallback and without user-defined or unused pieces is needed")
        if normal.precompiled_charsmap or not normal.add_dummy_prefix or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("only identity normalisation with a leading blank is supported")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        self.piece = {i: p.piece for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.bytes = [0] * 256
        self.surface: list[bytes] = []
        unknown = proto.trainer_spec.unk_surface.encode()
        for i, p in enumerate(proto.pieces):
            if p.type == _BYTE:
                value = int(p.piece[3:5], 16)  # <0xNN>
                self.bytes[value] = i
                self.surface.append(bytes([value]))
            else:
                self.surface.append(p.piece.replace(BLANK, " ").encode() if p.type == _NORMAL else unknown if p.type == _UNKNOWN else b"")
        self.is_normal = np.array([p.type == _NORMAL for p in proto.pieces])
        self.is_control = np.array([p.type == _CONTROL for p in proto.pieces])
        self._pairs: dict[tuple[int, int], bool] = {}
        self._segment_ids = _Remembered(self.encode_segment)
        self._word_ids = _Remembered(lambda word: self._encode_segments(BLANK + word))

    @cached_property
    def _known(self) -> frozenset[str]:
        """The characters that pieces contain."""
        return frozenset().union(*self.score)

    @cached_property
    def _segments(self) -> Callable[[str], list[str]]:
        return _cutter(self.score, sorted(self._known)).findall

    @cached_property
    def _ends(self) -> ahocorasick.Automaton:
        """All pieces, as (id, length); a character that pieces contain, but that is no piece, is a token of a negative id."""
        ends = ahocorasick.Automaton()
        for i, piece in self.piece.items():
            ends.add_word(piece, (i, len(piece)))
        for c in self._known - self.score.keys():
            self.piece[-1 - ord(c)] = c
            ends.add_word(c, (-1 - ord(c), 1))
        ends.make_automaton()
        return ends

    def merged(self, text: str) -> list[str]:
        """The pieces of a short string by its definition: of all neighbours that make a piece, those of the best score merge first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int | None, right: int) -> bool:
        """Whether two tokens side by side (or one alone, if ``left`` is None) stay as they are."""
        key = (left, right)
        found = self._pairs.get(key)
        if found is None:
            pieces = [self.piece[right]] if left is None else [self.piece[left], self.piece[right]]
            found = self.merged("".join(pieces)) == pieces
            if len(self._pairs) < _PAIRS:
                self._pairs[key] = found
        return found

    def last_tokens(self, segment: str) -> list[tuple[int, int]]:
        """For each non-empty prefix of a segment of known characters the last token of its encoding and that token's length."""
        last: list[tuple[int, int] | None] = [None] * (len(segment) + 1)
        pairs, compatible = self._pairs, self.compatible
        for end, token in self._ends.iter(segment):  # at each place, all pieces that end there
            if last[end + 1] is None:
                before = last[end + 1 - token[1]]
                left = before and before[0]
                fits = pairs.get((left, token[0]))
                if compatible(left, token[0]) if fits is None else fits:
                    last[end + 1] = token
        return last[1:]

    def encode_segment(self, segment: str) -> bytes:
        """The ids of a part that no piece goes across, its blanks escaped."""
        out = array("i")
        if segment[0] not in self._known:
            out.extend(self.bytes[b] for b in segment.encode())
            return out.tobytes()
        last, at, back = self.last_tokens(segment), len(segment), []
        while at:
            token, length = last[at - 1]
            back.append(token)
            at -= length
        for token in reversed(back):
            if token >= 0:
                out.append(token)
            else:
                out.extend(self.bytes[b] for b in chr(-1 - token).encode())
        return out.tobytes()

    def _encode_segments(self, escaped: str) -> bytes:
        return b"".join(map(self._segment_ids.__getitem__, self._segments(escaped)))

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers of this machine's byte order."""
        if not text:
            return b""
        if text[0] == " " or "  " in text or BLANK in text:
            return self._encode_segments(BLANK + text.replace(" ", BLANK))
        return b"".join(map(self._word_ids.__getitem__, text.split(" ")))  # single blanks: each word is its own part

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces side by side without the leading blank; runs of byte pieces are UTF-8, each byte that does not belong to a character becomes U+FFFD."""
        text = ""
        for run in np.split(ids, np.flatnonzero(self.is_control[ids])):  # control pieces have no text and end a run of bytes
            data = b"".join(map(self.surface.__getitem__, run.tolist()))
            run = run[~self.is_control[run]]
            if not text and len(run) and self.is_normal[run[0]] and data.startswith(b" "):
                data = data[1:]
            try:
                text += data.decode()
            except UnicodeDecodeError:
                text += _decode_bytewise(data)
        return text


class _Remembered(dict):
    """Ids of strings, made when they are first asked for; beyond the bound, and for long strings, not stored."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self._make = make

    def __missing__(self, key: str) -> bytes:
        ids = self._make(key)
        if len(key) <= _LONGEST and len(self) < _ENTRIES:
            self[key] = ids
        return ids


def _decode_bytewise(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as wrong:
            out.append(data[at : at + wrong.start].decode() + "�")
            at += wrong.start + 1
    return "".join(out)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(name: str = "piece_bpe_32k.model") -> Vocabulary:
    """One vocabulary for each Python worker."""
    if name not in _LOADED:
        _LOADED[name] = Vocabulary(public_tokenizers.path(name))
    return _LOADED[name]


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and ids, without begin or end ids.

    Null text counts as empty and has no ids. Null and repeated doc_ids are kept as they are, one
    row each; very long texts are encoded whole, in time and memory that grow with their length; an
    empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(model).encode
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                made = [encode(t.as_py() or "") for t in batch.column(1).slice(low, ROWS)]
                offsets = np.cumsum([0, *(len(m) // 4 for m in made)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, ROWS), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Per row of ``encoded`` (doc_id, ids): doc_id, ids and the decoded text; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary(model).decode
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                lists = part.column(1)
                texts = [decode(np.zeros(0, np.int32) if ids.values is None else ids.values.to_numpy(zero_copy_only=False)) for ids in lists]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def piece_digests(decoded: DataFrame) -> DataFrame:
    """Counts and digests of what ``decode_documents`` returns."""
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    joined = F.array_join(ids.cast("array<string>"), ",")
    return decoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
