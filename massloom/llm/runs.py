"""Periodic runs of words by the method of Kolpakov and Kucherov.

A suffix automaton gives the LZ factors of a word sequence. Runs that touch a border between factors
are found by Main's algorithm, which compares both sides of the border for each period that such a
run can have, in time proportional to the two factors beside it. All other runs lie inside a factor
and are copied from where the factor occurs before. Each step is linear in the sequence.

In a run that is long enough every short window of words occurs twice, so only the stretches whose
windows are repeated in the text are factorised; a run, and the words beside it that decide where it
ends, never reach out of such a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 64  # documents of one output batch
RUN = "struct<start: long, length: long, period: long>"
_STEPS = np.random.default_rng(11_041_999).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def suffix_automaton(symbols: Sequence[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The transitions of each state, and where the first occurrence of its strings ends."""
    link, length, moves, first, last = [-1], [0], [{}], [-1], 0
    for at, symbol in enumerate(symbols):
        new = len(length)
        length.append(length[last] + 1)
        first.append(at)
        moves.append({})
        link.append(0)
        state = last
        while state >= 0 and symbol not in moves[state]:
            moves[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = moves[state][symbol]
            if length[target] > length[state] + 1:  # the target's shorter strings get a state of their own
                part = len(length)
                length.append(length[state] + 1)
                first.append(first[target])
                moves.append(moves[target].copy())
                link.append(link[target])
                while state >= 0 and moves[state].get(symbol) == target:
                    moves[state][symbol] = part
                    state = link[state]
                link[target] = target = part
            link[new] = target
        last = new
    return moves, first


def lz_factors(symbols: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, end, distance) of each factor: the longest string that also starts ``distance`` earlier, or a single new symbol of distance 0."""
    moves, first = suffix_automaton(symbols)
    factors, start = [], 0
    while start < len(symbols):
        state, end = 0, start
        while end < len(symbols) and first[moves[state][symbols[end]]] < end:
            state = moves[state][symbols[end]]
            end += 1
        factors.append((start, end, end - 1 - first[state]) if end > start else (start, start + 1, 0))
        start = factors[-1][1]
    return factors


def prefix_matches(symbols: Sequence[int]) -> list[int]:
    """For each place how many symbols from there on equal those at the beginning (the Z function)."""
    n = len(symbols)
    out = [n] * min(n, 1) + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(out[i - left], right - i) if i < right else 0
        while i + k < n and symbols[k] == symbols[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        out[i] = k
    return out


def border_runs(symbols: Sequence[int], before: int, border: int, end: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs whose last symbol lies in the factor [border, end), or that end at ``border``, and that start at or before it.

    ``before`` is where the previous factor starts. Such a run starts less than one period before it,
    as otherwise that factor would be longer, and so its period is less than the two factors' length
    over ``times - 1``. What reaches beyond the window belongs to another border.
    """
    most = (end - before) // (times - 1) + 1
    low, high = max(0, before - most), min(len(symbols), end + 1)
    mark = [-1]
    ahead = symbols[border:high]
    behind = symbols[low:border][::-1]
    reach = min(border + most, high)
    right_on = prefix_matches(ahead)
    right_back = prefix_matches(behind + mark + symbols[low:reach][::-1])
    left_on = prefix_matches(ahead + mark + symbols[low:high])
    left_back = prefix_matches(behind)
    for period in range(1, most + 1):
        found = []
        if border + period <= reach:
            on = right_on[period] if period < len(ahead) else 0
            found.append((border - right_back[len(behind) + 1 + reach - border - period], border + period + on))
        if border - period >= low:
            back = left_back[period] if period < len(behind) else 0
            found.append((border - period - back, border + left_on[len(ahead) + 1 + border - period - low]))
        for start, stop in found:
            if stop - start >= max(least, times * period) and (start > low or low == 0) and (stop < high or high == len(symbols)):
                yield start, stop, period


def runs_of(symbols: Sequence[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run with ``least`` symbols and ``times`` periods or more, by start and period."""
    symbols = list(symbols)
    if not symbols:
        return []
    factors = lz_factors(symbols)
    known: dict[tuple[int, int], int] = {}
    for (before, border, _), (_, end, _) in zip(factors, [*factors[1:], (len(symbols), len(symbols), 0)], strict=True):
        for start, stop, period in border_runs(symbols, before, border, end, least, times):
            known[start, stop] = min(period, known.get((start, stop), period))  # a multiple of the period has the same borders
    starting: dict[int, list[tuple[int, int]]] = {}
    for (start, stop), period in known.items():
        starting.setdefault(start, []).append((stop, period))
    for start, end, distance in factors:
        for at in range(start + 1, end - least):
            for stop, period in starting.get(at - distance, ()):
                if stop + distance < end and (at, stop + distance) not in known:
                    known[at, stop + distance] = period
                    starting.setdefault(at, []).append((stop + distance, period))
    return sorted((start, stop - start, period) for (start, stop), period in known.items())


def repeated_stretches(symbols: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int]]:
    """Where every window of ``least * (1 - 2 / times)`` symbols occurs twice: all that runs can consist of."""
    width = max(1, least * (times - 2) // times)
    n = len(symbols) - width + 1
    if len(symbols) < least:
        return
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += (symbols[i : i + n].astype(np.uint64) + np.uint64(1)) * _STEPS[i % len(_STEPS)] * np.uint64(2 * (i // len(_STEPS)) + 1)
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(total, kind="stable")
    same = total[order[1:]] == total[order[:-1]]
    repeated = np.zeros(n + 2, bool)
    repeated[order[1:][same] + 1] = repeated[order[:-1][same] + 1] = True
    edges = np.flatnonzero(repeated[1:] != repeated[:-1])
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if high - low + width - 1 >= least:
            yield low, high + width - 1


def word_runs(words: Sequence[bytes], least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a word sequence."""
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    symbols = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    found = []
    for low, high in repeated_stretches(symbols, least, times):
        found += [(low + start, length, period) for start, length, period in runs_of(symbols[low:high].tolist(), least, times)]
    return sorted(found)


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def find_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, runs as an array of (start, length, period), and the collapsed text.

    Words are runs of bytes other than ASCII white space, numbered from 0. A run is a longest stretch
    of a smallest period, of ``least`` words and ``times`` (2 or more) periods at least; runs come by
    start and period. The collapsed text has of each run its first period only, words joined by
    one blank.

    Null text and text without words have no runs and an empty collapsed text. Null and repeated
    doc_ids are kept, one row each; very long texts are taken whole, in time and memory that grow
    with their length; an empty table gives no rows; other columns are not read.
    """
    if times < 2 or least < 1:
        raise ValueError("a run has two periods and one word at least")
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                found, kept = [], []
                for text in batch.column(1).slice(low, ROWS):
                    words = (text.as_py() or "").encode().split()
                    runs = word_runs(words, least, times)
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    kept.append(b" ".join(kept_words(words, runs)).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, ROWS), pa.array(found, pa.list_(run_type)), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, runs array<{RUN}>, collapsed string")


def plant_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``, in which a tenth of the documents, by a hash of their id, go on periodically from some word on.

    Rows with a null doc_id or without words stay as they are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.crc32(F.col("doc_id").cast("long").cast("string")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    as_int = lambda c: c.cast("int")
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    tail = F.flatten(F.array_repeat(F.slice("words", as_int(a + 1), as_int(p)), as_int(F.ceil((n - a) / p))))
    planted = F.concat(F.slice("words", F.lit(1), as_int(a)), F.slice(tail, F.lit(1), as_int(n - a)))
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def _strongest(runs: Column) -> Column:
    """The run of the greatest exact length over period; of equal ones the first by start and period."""
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of what ``find_runs`` returns."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    rows = found.select("doc_id", "runs", "collapsed", _strongest(F.col("runs")).alias("best"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# The check of SQL pairs equal windows of eight words; hashes of ids are reckoned bit by bit.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS raw FROM documents),
bits AS (SELECT doc_id, raw, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i::INT) & 1))) AS bits FROM d),
h AS (
    SELECT doc_id, raw, len(raw) AS n, xor(list_reduce(list_prepend(4294967295, list_transform(bits, lambda b: b::BIGINT)), lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h
    FROM bits
),
plan AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
planned AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM plan),
w AS (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN raw[i + 1] ELSE raw[a + (i - a) % p + 1] END) ELSE raw END AS words
    FROM planned
),
one AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(words) AS word FROM w),
windows AS (SELECT doc_id, n, i, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) AS gram FROM one),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i AND 3 * (y.i - x.i) <= x.n AND y.i + 8 <= y.n),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
best AS (SELECT doc_id, start, length, period, (1000 * length) // period AS exponent_milli FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM one ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
