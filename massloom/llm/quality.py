"""Quality classifier: naive Bayes support vectors (NB-SVM) over hashed n-gram indicators.

Log-count ratios come from all labelled training rows. The linear hinge-loss model is fitted by
dual coordinate descent on a sample whose size is bounded by a parameter, on indicators scaled by
these ratios; its margins are turned into probabilities on rows the fit has not seen.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 17
SAMPLE_ROWS = 6_000
THRESHOLD = 0.3


class Indicators:
    """Distinct hashed features of a text: its 2- to 4-grams of UTF-8 bytes, its words, its pairs of
    neighbouring words, and, as one pair whatever the word, 1, 2, 4, 8 ... pairs of a word twice.

    Bytes are read in blocks that overlap by one n-gram, so beside the words of one text memory does
    not grow with its length.
    """

    def __init__(self, bits: int = BITS, block: int = 1 << 16):
        self.size, self.bits, self.block = 1 << bits, bits, block
        self._seen = np.zeros(self.size, bool)

    def _slots(self, code: np.ndarray, kind: int) -> np.ndarray:
        return ((code * np.uint32(0x9E3779B1) + np.uint32(kind * 0x3F4A7C15 & 0xFFFFFFFF)) ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - self.bits)

    def __call__(self, text: str | bytes | None) -> np.ndarray:
        whole = text if isinstance(text, bytes) else (text or "").encode()
        data = np.frombuffer(whole, np.uint8)
        for low in range(0, max(len(data), 1), self.block):
            part = data[low : low + self.block + 3].astype(np.uint32)
            code = part
            for n in (2, 3, 4):
                if len(part) < n:
                    break
                code = (code[: len(part) - n + 1] << np.uint32(8)) ^ part[n - 1 :]
                self._seen[self._slots(code, n)] = True
        words = whole.split()
        codes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        self._seen[self._slots(codes, 5)] = True
        self._seen[self._slots(codes[:-1] * np.uint32(0x2545F491) ^ codes[1:], 6)] = True
        doubled = int((codes[1:] == codes[:-1]).sum()).bit_length()
        self._seen[self._slots(np.arange(doubled, dtype=np.uint32), 7)] = True
        found = np.flatnonzero(self._seen)
        self._seen[found] = False
        return found.astype(np.int32)


def training_labels(labels: DataFrame, label: str, held_out: int) -> DataFrame:
    """id and y of the labels that may be learned from."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
    return known.filter("id IS NOT NULL AND y IN (0, 1)").filter(F.crc32(F.col("id").cast("string")) % held_out != 0)


def _packed(docs: DataFrame, held_out: int) -> DataFrame:
    """(id, packed text) of the documents that may be learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                ids, texts = batch.column(0).slice(low, 512), batch.column(1).slice(low, 512)
                yield pa.RecordBatch.from_arrays([ids, pa.array([pack((t.as_py() or "").encode()) for t in texts], pa.binary())], ["id", "packed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).filter("id IS NOT NULL")
    return rows.filter(F.crc32(F.col("id").cast("string")) % held_out != 0).mapInArrow(run, "id long, packed binary")


def count_features(rows: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature counts by class, rows by class) over all rows.

    Each task adds up two arrays of 2**bits counts and sends on only them, so what meets on the
    driver is bounded by ``bits``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts, n = Indicators(bits), np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for packed, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[y, features(unpack(packed.as_py()))] += 1
                n[y] += 1
        for y in (0, 1):
            slots = np.flatnonzero(counts[y])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(slots) + 1, y), pa.int32()), pa.array(np.append(slots, -1), pa.int32()), pa.array(np.append(counts[y, slots], n[y]), pa.int64())], ["y", "slot", "n"]
            )

    total = rows.select("packed", "y").mapInArrow(run, "y int, slot int, n long").groupBy("y", "slot").agg(F.sum("n").alias("n")).toArrow()
    y, slot, n = (total.column(c).to_numpy() for c in ("y", "slot", "n"))
    counts, rows_of = np.zeros((2, 1 << bits)), np.zeros(2)
    inside = slot >= 0
    counts[y[inside], slot[inside]] = n[inside]
    rows_of[y[~inside]] = n[~inside]
    return counts, rows_of


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, factor: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised linear model under hinge loss, by dual coordinate descent.

    Row i has factor[i] * scale[j] at each slot j of rows[i]; its dual variable stays within
    [0, cost[i]]. Values are made as they are needed, so memory is that of the slots.
    """
    weights, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float((scale[r] ** 2).sum()) * f * f + 1.0 for r, f in zip(rows, factor, strict=True)])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            slots = rows[i]
            values = scale[slots] * factor[i]
            gradient = y[i] * (weights[slots] @ values + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                largest = max(largest, abs(step) * math.sqrt(norms[i]))
                weights[slots] += step * values
                bias += step
                alpha[i] = new
        if largest < 1e-3:
            break
    return weights, bias


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn margins into probabilities (Newton, targets smoothed)."""
    positives, negatives = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (positives + 1) / (positives + 2), 1 / (negatives + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w, g = p * (1 - p) + 1e-9, target - p
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum()]])
        step = np.linalg.solve(h, np.array([(g * margins).sum(), g.sum()]))
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


@dataclass
class QualityModel:
    bits: int
    weights: np.ndarray  # ratios already multiplied in
    bias: float
    slope: float
    intercept: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum() / math.sqrt(max(1, len(features))) + self.bias)

    def probability(self, features: np.ndarray) -> float:
        z = self.slope * self.margin(features) + self.intercept
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))

    def score(self, docs: DataFrame) -> DataFrame:
        """(row, score) of ``docs``: each row as a struct and its score; every row gets one, empty and null texts too."""
        model = self
        columns = [F.col(f"`{c}`") for c in docs.columns]
        rows = docs.select(F.struct(*columns).alias("row"), F.col("text").cast("string").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = Indicators(model.bits)
            for batch in batches:
                scores = [model.probability(features(text.as_py())) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

        return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = 5, bits: int = BITS, sample_rows: int = SAMPLE_ROWS, cost: float = 1.0, epochs: int = 30, seed: int = 7) -> QualityModel:
    """Fit on rows whose crc32(doc_id as text) mod ``held_out`` is not 0.

    Counts are over all of them; the hinge-loss fit takes at most ``sample_rows`` rows, from either
    class at most half, those with the smallest seeded hash of doc_id. Of
    these, one row in five sets the probabilities. Without rows of both classes every score is the
    share of class 1 (0.5 without any).
    """
    known = training_labels(labels, label, held_out)
    # Labels grow with the documents, so this is a shuffle at every size; the texts pass it packed.
    rows = _packed(docs, held_out).join(known.hint("merge"), "id")
    counts, n = count_features(rows, bits)
    if not n.all():
        share = (n[1] + 1) / (n.sum() + 2)
        return QualityModel(bits, np.zeros(1 << bits), 0.0, 1.0, math.log(share / (1 - share)))
    p, q = counts[1] + 1.0, counts[0] + 1.0
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(counts[0] + counts[1]) < 2] = 0.0

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Indicators(bits)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([features(t.as_py()) for t in part.column(0)], pa.list_(pa.int32()))], ["y", "slots"])

    place = F.xxhash64(F.col("id"), F.lit(seed))
    parts = [known.filter(F.col("y") == y).orderBy(place, "id").limit(sample_rows // 2) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # sample_rows rows of two numbers at most
    got = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id")).select("text", "y").mapInArrow(extract, "y int, slots array<int>").toArrow()
    y = np.where(got.column("y").to_numpy() == 1, 1.0, -1.0)
    flat = [np.asarray(x.values, np.int32) for chunk in got.column("slots").chunks for x in chunk]
    del got, counts
    lengths = np.array([max(1, len(r)) for r in flat], float)
    order = np.random.default_rng(seed).permutation(len(flat))
    hold, fit = order[: len(order) // 5], order[len(order) // 5 :]

    def fitted(index: np.ndarray) -> tuple[np.ndarray, float]:
        chosen_y = y[index]
        balance = {s: len(index) / 2 / max(1, (chosen_y == s).sum()) for s in (-1.0, 1.0)}
        # Divided by the root of the number of indicators, so long texts weigh like short ones.
        return dual_coordinate_descent([flat[i] for i in index], ratio, 1 / np.sqrt(lengths[index]), chosen_y, cost * np.array([balance[s] for s in chosen_y]), epochs, seed)

    weights, bias = fitted(fit)
    model = QualityModel(bits, weights * ratio, bias, 1.0, 0.0)
    slope, intercept = logistic(np.array([model.margin(flat[i]) for i in hold]), y[hold]) if len(hold) > 20 else (2.0, 0.0)
    return QualityModel(bits, weights * ratio, bias, slope, intercept)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: int = 5, threshold: float = THRESHOLD, **fit: object) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null and empty texts have no indicators and all get one score; a null doc_id has held_out null;
    rows that repeat a doc_id are each scored; an empty table gives no rows, and empty labels the
    score 0.5; other columns are not read.
    """
    scored = fit_quality(docs, labels, held_out=held_out, **fit).score(docs.select("doc_id", "text"))
    return scored.select(
        "row.doc_id",
        (F.crc32(F.col("row.doc_id").cast("string")) % held_out == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fit: object) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``; all columns stay. Awkward rows are as in ``quality_scores``."""
    model = fit_quality(docs, labels, **fit)
    return model.score(docs).filter(F.col("score") >= threshold).select("row.*")
