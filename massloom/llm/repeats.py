"""Removal of repeated substrings by a sampled suffix array with bucket-pointer refinement.

A suffix starts in the bucket of its first eight bytes; a bucket is refined by the bucket
identifiers of later offsets, so that depth doubles (16, 32, 64) and then reaches the match length,
each step reusing the identifiers just refined. Identifiers are content hashes, so a document
refines its own suffixes without seeing others, and equal identifiers mean equal bytes across
documents. Many texts lie side by side in one array and are refined together.

Only sampled suffixes are sorted across documents. Every window of the match length is represented
by its least 16-gram bucket, its anchor; equal windows have equal anchors at equal offsets. The
windows of one anchor make a segment. Segments are sorted by (bucket, refined identifier,
document): later copies of a segment are removed whole. Where a bucket holds different segments,
their first copies are cut into parts, whose buckets are refined by what the windows of a part
have in common, and sorted again; where parts still differ, their windows are sorted one by one.

Buckets that a sample of the documents shows to be crowded are dealt by (bucket, identifier) and
taken to hold different segments, which costs refinement only; so no bucket has to fit one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.session import Scratch, shuffle_width

LENGTH = 100
GRAM = 16
EDGES = -(-(LENGTH - GRAM + 1) * np.arange(9) // 8)  # of the eight parts of a segment, as offsets of its anchor
BLOCK = 1 << 16  # bytes that are refined at once; a segment cut at a block's end is a segment of its own
FLUSH = 300_000  # rows that a task sorts before the shuffle
STEP = 4096  # marks of one text that are refined at once
PENDING = 4096  # undecided first copies of one bucket that are held; beyond, the bucket is taken as mixed
CROWDED = 64  # rows of one bucket among a hundredth of the documents from which it counts as crowded
_DRAW = np.random.default_rng(6_021_023)
_STEPS = _DRAW.integers(1, 1 << 63, (2, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _DRAW.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROW = "k long, id long, doc_id long, text long, at long"
MARK = "doc_id long, text long, mark long"


def _place(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A run of windows as one number: first start, then how many, below 128."""
    return (start.astype(np.int64) << 7) | count


def initial_buckets(data: np.ndarray) -> np.ndarray:
    """The first eight bytes of each suffix as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,)).copy()


def refine(grams: np.ndarray, lane: int, length: int) -> dict[int, np.ndarray]:
    """Bucket identifiers by depth, for depths 8, 16, 32 ... and ``length``, from ``initial_buckets``."""
    steps = _STEPS[lane]
    bucket = grams * steps[7]
    bucket ^= bucket >> np.uint64(32)
    depth, level, found = 8, 0, {8: bucket}
    while depth < length:
        later = min(depth, length - depth)  # the last step overlaps what is refined already
        n = max(0, len(bucket) - later)
        finer = bucket[:n] * steps[level]
        finer += bucket[later : later + n]
        finer ^= finer >> np.uint64(29)
        bucket, depth, level = finer, depth + later, level + 1
        found[depth] = bucket
    return found


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams the place of its least by the upper bits, the leftmost of equals."""
    low = np.uint64((1 << 24) - 1)  # runs lie in blocks far below that
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        n = max(0, len(least) - step)
        least = np.minimum(least[:n], least[step : step + n])
        have += step
    return (least & low).astype(np.int64)


def _ranges(firsts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers first, first + 1 ... of each range, which range each belongs to)."""
    of = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(of)) + np.repeat(firsts - (np.cumsum(counts) - counts), counts), of


def segments_of(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, start in the piece, count, bucket, identifier) of the segments of pieces that lie side by side in ``data``."""
    starts = np.cumsum(sizes) - sizes
    first = initial_buckets(data)
    grams = refine(first, 0, GRAM)[GRAM]
    full = refine(first, 1, LENGTH)[LENGTH]
    window, piece = _ranges(starts, np.maximum(sizes - LENGTH + 1, 0))
    anchor = anchors(grams, LENGTH - GRAM + 1)[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    cut = np.flatnonzero(new)
    count = np.diff(np.append(cut, len(window)))
    low, at = window[cut], anchor[cut]
    return piece[cut], low - starts[piece[cut]], count, grams[at], _identity(full, low, low + count - 1, at)


def _identity(full: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """One identifier of all windows from first to last, which overlap, around an anchor."""
    shape = ((last - first).astype(np.uint64) << np.uint64(32)) + (anchor - first).astype(np.uint64)
    identity = full[first] * _MIX[0] + full[last] * _MIX[1] + shape * _MIX[2]
    identity ^= identity >> np.uint64(31)
    return identity * _MIX[3]


def _combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows (k, id, doc_id, text, at, crowded) sorted here; copies that certainly are later are marked so and dealt at random.

    at becomes place << 2, with bit 0 for later rows and bit 1 for rows of crowded buckets, which
    are dealt by bucket and identifier.
    """
    k, i, doc, text, at, crowded = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((at, text, doc, i, k))
    k, i, doc, text, at, crowded = (x[order] for x in (k, i, doc, text, at, crowded))
    later, _ = _later(k, i, doc, text, at)
    at = (at << 2) | (crowded.astype(np.int64) << 1) | later
    k = np.where(crowded, (k * _MIX[6]) ^ (i * _MIX[7]), k)
    spread = (doc.view(np.uint64) * _MIX[4]) ^ (at.view(np.uint64) * _MIX[5])
    k, i = np.where(later, spread, k), np.where(later, np.uint64(0), i)
    return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(i.view(np.int64)), pa.array(doc), pa.array(text), pa.array(at)], ["k", "id", "doc_id", "text", "at"])


def _later(k: np.ndarray, i: np.ndarray, doc: np.ndarray, text: np.ndarray, at: np.ndarray, before: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """Which rows, sorted by (k, id, doc_id, text, at), stand earlier in another document or in their own text; and the state after them.

    The state is (k, id, first doc_id of these, doc_id, text, first place in that text) of the last row.
    """
    group, own = np.ones(len(k), bool), np.ones(len(k), bool)
    group[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
    own[1:] = group[1:] | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    if before is not None:
        group[0] = (k[0], i[0]) != before[:2]
        own[0] = group[0] or (doc[0], text[0]) != before[3:5]
    rows = np.arange(len(k))
    lead, own_lead = np.maximum.accumulate(np.where(group, rows, -1)), np.maximum.accumulate(np.where(own, rows, -1))
    owner = np.where(lead >= 0, doc[lead], 0 if before is None else before[2])
    first_at = np.where(own_lead >= 0, at[own_lead], 0 if before is None else before[5])
    return (doc != owner) | (at > first_at), (k[-1], i[-1], owner[-1], doc[-1], text[-1], first_at[-1])


def later_occurrences(rows: DataFrame, shared: bool) -> DataFrame:
    """(doc_id, text, mark) for rows as ``_combined`` leaves them.

    mark is place << 1 for rows whose (k, id) stands earlier; with ``shared`` also place << 1 | 1
    for the others of each k that has several ids, or is crowded. Rows arrive sorted and only the
    last row and at most ``PENDING`` undecided rows are held, whatever the size of a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, pending, several = None, [], False  # several: whether the bucket of the last row is known as mixed
        for batch in batches:
            k, i, doc, text, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            known = (at & 1) == 1
            out = [(doc[known], text[known], (at[known] >> 2) << 1)]
            k, i, doc, text, at = (x[~known] for x in (k, i, doc, text, at))
            if len(k):
                crowded, at = (at & 2) == 2, at >> 2
                last = before
                later, before = _later(k, i, doc, text, at, last)
                out.append((doc[later], text[later], at[later] << 1))
                if shared:
                    new_k = np.ones(len(k), bool)
                    new_k[1:] = k[1:] != k[:-1]
                    new_k[0] = last is None or k[0] != last[0]
                    new_i = np.ones(len(k), bool)
                    new_i[1:] = new_k[1:] | (i[1:] != i[:-1])
                    new_i[0] = new_k[0] or i[0] != last[1]
                    bucket = np.cumsum(new_k)  # 0: the bucket that the rows before end with
                    mixed = np.bincount(bucket, (new_i & ~new_k) | crowded, minlength=bucket[-1] + 1) > 0
                    mixed[0] |= several
                    if pending and not new_k[0] and mixed[0]:
                        out.append(tuple(np.array(x, np.int64) for x in zip(*pending, strict=True)))
                    if new_k.any() or mixed[0]:
                        pending = []
                    tied = ~later & mixed[bucket]
                    out.append((doc[tied], text[tied], (at[tied] << 1) | 1))
                    several = bool(mixed[bucket[-1]])
                    if not several:
                        open_rows = np.flatnonzero(~later & (bucket == bucket[-1]))
                        pending += zip(doc[open_rows].tolist(), text[open_rows].tolist(), ((at[open_rows] << 1) | 1).tolist(), strict=True)
                        if len(pending) > PENDING:
                            out.append(tuple(np.array(x, np.int64) for x in zip(*pending, strict=True)))
                            pending, several = [], True
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["doc_id", "text", "mark"])

    return rows.repartition("k").sortWithinPartitions("k", "id", "doc_id", "text", "at").mapInArrow(run, MARK)


def _text_key(raw: bytes | memoryview) -> int:
    """Tells texts of one doc_id apart."""
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                raw = batch.column(1).slice(low, 512).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, 512), pa.array(map(_text_key, raw), pa.int64()), pa.array(map(pack, raw), pa.binary())], ["doc_id", "text", "packed"])

    return docs.mapInArrow(run, "doc_id long, text long, packed binary")


def _pieces(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, base in its text, size) of pieces of texts, up to about a block of bytes at a time; no window is cut."""
    sizes = np.diff(offsets)
    low = 0
    while low < len(sizes):
        if sizes[low] > BLOCK:
            for base in range(0, int(sizes[low]) - LENGTH + 1, BLOCK):
                yield np.array([low]), np.array([base]), np.array([min(BLOCK + LENGTH - 1, sizes[low] - base)])
            low += 1
            continue
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BLOCK, "right")) - 1)
        long = np.flatnonzero(sizes[low:high] > BLOCK)
        high = low + int(long[0]) if len(long) else high
        yield np.arange(low, high), np.zeros(high - low, np.int64), sizes[low:high]
        low = high


def _segment_rows(docs: DataFrame, crowded: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            if offsets[-1] == offsets[0]:
                continue
            data = np.frombuffer(column.buffers()[2], np.uint8)
            doc, view = batch.column(0).to_numpy(zero_copy_only=False), memoryview(column.buffers()[2])
            keys = np.array([_text_key(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
            for row, base, sizes in _pieces(offsets):
                low = offsets[row[0]] + base[0]
                piece, start, count, bucket, identity = segments_of(data[low : low + sizes.sum()], sizes)
                if len(piece):
                    of = row[piece]
                    parts.append((bucket, identity, doc[of], keys[of], _place(start + base[piece], count), np.isin(bucket, crowded)))
                    held += len(piece)
                if held >= FLUSH:
                    yield _combined(parts)
                    parts, held = [], 0
        if parts:
            yield _combined(parts)

    return docs.mapInArrow(run, ROW)


def _crowded_buckets(docs: DataFrame) -> np.ndarray:
    """Buckets of which a hundredth of the documents has ``CROWDED`` rows or more, the largest first, at most four for each shuffle partition.

    They only say how rows are dealt out; results do not depend on them.
    """
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.length("raw")), F.lit(100)) == 0)
    rows = _segment_rows(sample, np.zeros(0, np.uint64)).filter("(at & 1) = 0").groupBy("k").count().filter(F.col("count") >= CROWDED)
    top = rows.orderBy(F.desc("count"), "k").limit(4 * shuffle_width(docs.sparkSession)).collect()
    return np.sort(np.array([r["k"] for r in top], np.int64).view(np.uint64))


class _Regions:
    """The marked runs of windows of several texts, with only the bytes that they cover, side by side."""

    def __init__(self):
        self.data: list[bytes] = []
        self.size = 0
        self.rows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, doc: int, text: int, raw: bytes, marks: list[int]) -> None:
        place = np.unique(np.array(marks, np.int64)) >> 1
        start, count = place >> 7, place & 127
        end = np.maximum.accumulate(start + count + LENGTH - 1)
        new = np.ones(len(start), bool)
        new[1:] = start[1:] >= end[:-1]
        heads = np.flatnonzero(new)
        low, high = start[heads], end[np.append(heads[1:] - 1, len(start) - 1)]
        sizes = high - low
        shift = self.size + np.cumsum(sizes) - sizes - low
        self.data += [raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        self.rows.append((doc, text, start, count, shift[np.cumsum(new) - 1]))
        self.size += int(sizes.sum())

    def joined(self) -> tuple[np.ndarray, ...]:
        """(bytes, doc_id, text, start, count, how far the start lies further on in the bytes)."""
        sizes = [len(r[2]) for r in self.rows]
        doc, text = (np.repeat(np.array([r[c] for r in self.rows], np.int64), sizes) for c in (0, 1))
        return np.frombuffer(b"".join(self.data), np.uint8), doc, text, *(np.concatenate([r[c] for r in self.rows]) for c in (2, 3, 4))


def _part_rows(regions: _Regions, crowded: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows (k, id, doc_id, text, at, crowded) of the parts of marked segments.

    Part q has the windows whose anchor lies q / 8 to (q + 1) / 8 of the way into the range of
    offsets. Its bucket is what all its windows have in common, from the largest start to the end of
    the least; it is crowded if the segment's is, which equal parts have in common.
    """
    data, doc, text, start, count, shift = regions.joined()
    first = initial_buckets(data)
    near, full = refine(first, 0, 64), refine(first, 1, LENGTH)[LENGTH]
    low = start + shift
    anchor = anchors(near[GRAM], LENGTH - GRAM + 1)[low]
    q = np.tile(np.arange(8), len(low))
    of = np.repeat(np.arange(len(low)), 8)
    a = np.maximum(low[of], anchor[of] - EDGES[q + 1] + 1)
    b = np.minimum(low[of] + count[of] - 1, anchor[of] - EDGES[q])
    some = a <= b
    q, of, a, b = q[some], of[some], a[some], b[some]
    begin = anchor[of] - EDGES[q]
    end = anchor[of] - EDGES[q + 1] + 1 + LENGTH
    core = near[64][begin] * _MIX[0] + near[64][end - 64] * _MIX[1] + (q.astype(np.uint64) + np.uint64(1)) * _MIX[6]
    core ^= core >> np.uint64(30)
    return core, _identity(full, a, b, anchor[of]), doc[of], text[of], _place(a - shift[of], b - a + 1), np.isin(near[GRAM][anchor], crowded)[of]


def _window_rows(regions: _Regions, crowded: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows (k, id, doc_id, text, at, crowded) of the windows of marked parts; their buckets are as fine as can be."""
    data, doc, text, start, count, shift = regions.joined()
    first = initial_buckets(data)
    window, of = _ranges(start + shift, count)
    one, two = (refine(first, lane, LENGTH)[LENGTH][window] for lane in (0, 1))
    return one, two, doc[of], text[of], _place(window - shift[of], np.ones(len(window), np.int64)), np.zeros(len(window), bool)


def _finer_rows(flagged: DataFrame, windows: bool, crowded: np.ndarray) -> DataFrame:
    """Rows of the parts of the segments, or of the windows of the parts, that rows (doc_id, text, packed, split) ask for."""
    make = _window_rows if windows else _part_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        parts, held, regions = [], 0, _Regions()

        def put() -> Iterator[pa.RecordBatch]:
            nonlocal parts, held, regions
            rows = make(regions, crowded)
            parts, held, regions = [*parts, rows], held + len(rows[0]), _Regions()
            if held >= FLUSH:
                yield _combined(parts)
                parts, held = [], 0

        for batch in batches:
            for doc, text, packed, split in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = unpack(packed)
                # A very long text is taken in steps, too; marks that share bytes may be refined twice.
                marks = sorted(split)
                for low in range(0, len(marks), STEP):
                    regions.add(doc, text, raw, marks[low : low + STEP])
                    if regions.size >= BLOCK:
                        yield from put()
        if regions.rows:
            yield from put()
        if parts:
            yield _combined(parts)

    return flagged.mapInArrow(run, ROW)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of lists of numbers; a null is an empty list."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))


def removed_runs(place: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of bytes (start, end) that the windows of these places cover."""
    if not len(place):
        return []
    place = np.sort(place)
    start, end = place >> 7, np.maximum.accumulate((place >> 7) + (place & 127) + LENGTH - 1)
    new = np.ones(len(place), bool)
    new[1:] = start[1:] > end[:-1]
    heads = np.flatnonzero(new)
    return list(zip(start[heads].tolist(), end[np.append(heads[1:] - 1, len(place) - 1)].tolist(), strict=True))


def _remaining(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    pieces, at = [], 0
    for low, high in runs:
        pieces.append(raw[at:low])
        at = high
    return b"".join([*pieces, raw[at:]])


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Remove each byte that a 100-byte string covers which also starts earlier in ``docs`` (doc_id, text).

    Earlier is a smaller doc_id, or an earlier start in the same document; strings are judged on
    the input. Returns doc_id, n_bytes, removed (array of start and end in bytes) and kept, the
    remaining bytes; with ``digest`` their kept_sha256 in place of kept.

    Null text counts as empty, a null doc_id as the least; texts that share a doc_id are judged
    each for itself and do not count as earlier for one another; an empty table gives no rows;
    other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), text)
    key = ["doc_id", "text"]
    crowded = _crowded_buckets(rows)

    of_text = lambda found, name: found.groupBy(*key).agg(F.collect_list("mark").alias(name))
    split = lambda name: F.filter(name, lambda m: m.bitwiseAND(1) == 1).alias("split")
    later = lambda name: F.transform(F.filter(name, lambda m: m.bitwiseAND(1) == 0), lambda m: F.shiftright(m, 1)).alias(name)

    marks = scratch.keep(of_text(later_occurrences(_segment_rows(rows, crowded), shared=True), "marks"), "marks")
    # One plan from here on, so that the texts' shuffle is made once and used by all three.
    packed = _packed(rows).filter("doc_id IS NOT NULL AND text IS NOT NULL")  # as inner joins would, so that the outer join's plan is the same

    def asked(found: DataFrame, name: str) -> DataFrame:
        return packed.join(found.select(*key, split(name)).filter("size(split) > 0").hint("merge"), key).select(*key, "packed", "split")

    part_marks = of_text(later_occurrences(_finer_rows(asked(marks, "marks"), False, crowded), shared=True), "part_marks")
    window_marks = of_text(later_occurrences(_finer_rows(asked(part_marks, "part_marks"), True, crowded), shared=False), "window_marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sizes, spans, kept = [], [], []
                places = [_lists(c) for c in part.columns[2:]]
                for row, data in enumerate(part.column(1).to_pylist()):
                    raw = unpack(data)
                    runs = removed_runs(np.concatenate([values[ends[row] : ends[row + 1]] for values, ends in places]))
                    rest = _remaining(raw, runs)
                    sizes.append(len(raw)), spans.append([{"start": s, "end": e} for s, e in runs])
                    kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pair)), pa.array(kept, pa.string() if digest else pa.binary())], ["doc_id", "n_bytes", "removed", "kept"]
                )

    whole = packed
    for more, name in ((marks, "marks"), (part_marks, "part_marks"), (window_marks, "window_marks")):
        whole = whole.join(more.select(*key, later(name)).hint("merge"), key, "left")
    out = whole.select("doc_id", "packed", "marks", "part_marks", "window_marks")
    out = out.mapInArrow(run, f"doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept {'string' if digest else 'binary'}")
    out = out.withColumn("doc_id", F.nullif("doc_id", F.lit(-(1 << 63))))
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out


def repeat_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what ``remove_repeats`` returns."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    digest = F.col("kept_sha256") if "kept_sha256" in found.columns else F.sha2("kept", 256)
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), digest.alias("kept_sha256"))
