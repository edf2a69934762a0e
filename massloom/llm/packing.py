"""Best-fit packing of tokenised documents into sequences by exact-complement hashing.

Pieces of one length are interchangeable, so the plan is made over a histogram of lengths, which
has at most ``capacity`` entries whatever the corpus holds. The histogram is the only thing that
reaches the driver; pieces are numbered within their length in parallel and look up their place in
the plan, whose size is bounded by a function of ``capacity`` alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massloom.llm.tokenize import tokenizer
from massloom.session import Scratch, shuffle_width

END_ID = 2


def cut_documents(docs: DataFrame, capacity: int, vocabulary: str = "byte_bpe_50k", end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and then ``end_id``; null and empty texts are the end id alone. Longer
    ones are cut into pieces of ``capacity``, of which the first holds the remainder. Repeated rows
    each give their own pieces; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low in range(0, batch.num_rows, 256):
                docs_out, pieces, starts, lengths, sums, kept = [], [], [], [], [], []
                for doc, text in zip(ids.slice(low, 256).to_pylist(), texts.slice(low, 256).to_pylist(), strict=True):
                    data = encode(text or "") + end
                    total = len(data) // 4
                    start, piece = 0, 0
                    while start < total:
                        length = (total - start - 1) % capacity + 1 if not start else capacity
                        part = data[4 * start : 4 * (start + length)]
                        docs_out.append(doc), pieces.append(piece), starts.append(start), lengths.append(length), sums.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(np.frombuffer(part, "<u4").astype(np.int32))
                        start, piece = start + length, piece + 1
                columns = [pa.array(docs_out, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences), for a histogram of lengths.

    Going down from the longest remaining length, the gap of a sequence is filled exactly by one
    length, else by a pair, else by a triple, as far as the counts reach. What has no exact
    complement is then packed best-fit: each sequence takes the longest piece that still fits.
    Every step uses up a length or closes a pattern, so the number of patterns depends on
    ``capacity`` only.
    """
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> None:
        need: dict[int, int] = {}
        for length in lengths:
            need[length] = need.get(length, 0) + 1
        times = min(int(have[length]) // n for length, n in need.items())
        if times:
            for length, n in need.items():
                have[length] -= n * times
            plan.append((lengths, times))

    def pair_for(gap: int, first: int) -> tuple[int, int] | None:
        big = np.arange(gap - 1, (gap - 1) // 2, -1)
        spare = have.copy()
        spare[first] -= 1
        ok = (spare[big] > 0) & (spare[gap - big] > (big * 2 == gap))
        return (int(big[ok.argmax()]), int(gap - big[ok.argmax()])) if ok.any() else None

    def triple_for(gap: int, first: int) -> tuple[int, int, int] | None:
        spare = have.copy()
        spare[first] -= 1
        for one in range(gap - 2, (gap - 1) // 3, -1):
            if spare[one] > 0:
                spare[one] -= 1
                rest = gap - one
                big = np.arange(min(one, rest - 1), (rest - 1) // 2, -1)
                if big.size:
                    ok = (spare[big] > 0) & (spare[rest - big] > (big * 2 == rest))
                    if ok.any():
                        return one, int(big[ok.argmax()]), int(rest - big[ok.argmax()])
                spare[one] += 1
        return None

    take(capacity)
    for first in range(capacity - 1, 0, -1):
        gap = capacity - first
        if have[first] and gap <= capacity:
            take(first, gap)
            while have[first] and (found := pair_for(gap, first)):
                take(first, *found)
            while have[first] and (found := triple_for(gap, first)):
                take(first, *found)
    while have.any():
        pattern, room = [], capacity
        spare = have.copy()
        while room and (fits := np.flatnonzero(spare[: room + 1])).size:
            length = int(fits[-1])
            fit = min(int(spare[length]), room // length)
            pattern += [length] * fit
            spare[length] -= fit
            room -= fit * length
        take(*pattern)
    return plan


def place_pieces(pieces: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``pieces`` must be a table that reads the same again.

    A piece's number within its length is a count of whole cells before it plus its number inside
    its own cell (length, hash of the document), so no length gathers in one task.
    """
    spark = pieces.sparkSession
    cells = 8 * shuffle_width(spark)
    keyed = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)).cast("int"))
    in_cell = keyed.groupBy("length", "cell").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in in_cell.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = plan_sequences(totals, capacity)

    # Of each length, the plan's slots in order: from which number on, which first sequence and which offset.
    used: dict[int, int] = dict.fromkeys(totals, 0)
    slots: dict[int, list[tuple[int, int, int]]] = {length: [] for length in totals}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            slots[length].append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    tiles = {length: np.array(rows, np.int64).T for length, rows in slots.items()}  # bounded by capacity, like the plan

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = in_cell.select("length", "cell", before.alias("before"))
    ranked = (
        keyed.withColumn("own", F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "start", "ids_crc32")))
        .join(offsets, ["length", "cell"])
        .withColumn("number", F.col("before") + F.col("own") - 1)
        .drop("cell", "own", "before")
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            sequence_ids, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                rows = np.flatnonzero(length == one)
                lows, firsts, places = tiles[int(one)]
                slot = np.searchsorted(lows, number[rows], "right") - 1
                sequence_ids[rows] = firsts[slot] + number[rows] - lows[slot]
                offsets[rows] = places[slot]
            keep = [i for i, c in enumerate(batch.schema.names) if c != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence_ids), pa.array(offsets)], [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "number") + ", sequence_id long, offset long"
    return ranked.mapInArrow(look_up, schema)


def pack_documents(docs: DataFrame, capacity: int = 1024, vocabulary: str = "byte_bpe_50k", with_ids: bool = True) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, ids (unless ``with_ids`` is
    false), sequence_id and offset. An empty table gives no rows; repeated rows are packed as often
    as they stand there; a null doc_id stays null.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(cut_documents(docs, capacity, vocabulary, with_ids=with_ids), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset"]
    return place_pieces(pieces, capacity, scratch).select(names)
