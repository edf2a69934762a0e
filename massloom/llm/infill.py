"""Fill-in-middle transformation by a streaming matcher that reads each text twice and stores no units.

The first pass counts the units of a text. Two ranks are drawn from their number, and the second
pass advances one lazy match iterator to the smaller rank and on to the larger one. Besides the
text and its output nothing grows with a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
# The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ROWS = 256  # documents of one output batch


def count_units(text: str) -> int:
    """How many units a text has, by one pass over its matches."""
    return sum(1 for _ in UNIT.finditer(text))


def cut_places(text: str, low: int, high: int) -> tuple[int, int]:
    """Where the first ``low`` and the first ``high`` units end (low <= high), by one lazy pass as far as the larger rank."""
    matches = UNIT.finditer(text)
    first = next(islice(matches, low - 1, None)).end() if low else 0
    second = next(islice(matches, high - low - 1, None)).end() if high > low else first
    return first, second


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document; a null id draws as an empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def transform(doc_id: int | None, text: str, fim_percent: int, spm_percent: int, seed: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    n = count_units(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= fim_percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cut_places(text, low, high)
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def fill_in_middle(docs: DataFrame, fim_percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n (units), form, prefix_chars, middle_chars and output.

    Units are runs of ASCII letters and all other single code points. Prefix and middle end at
    random ranks; ``form`` is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain.
    Texts that are empty or contain a sentinel stay plain, so ``restored`` is exact.

    Null text counts as empty; a null doc_id draws as an empty string; rows that repeat a doc_id draw
    the same numbers, and equal rows give equal results. Very long texts are read as they are, twice.
    An empty table gives no rows; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                ids = batch.column(0).slice(low, ROWS)
                texts = batch.column(1).slice(low, ROWS)
                made = [transform(i.as_py(), t.as_py() or "", fim_percent, spm_percent, seed) for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), list(schema)[1:], strict=True))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str, form: Column | str) -> Column:
    """The exact text, read back from an output and its form; pieces of a text never contain a sentinel."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}", -1), F.split(body, f"{PREFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def infill_digests(made: DataFrame) -> DataFrame:
    """What ``fill_in_middle`` returns, with digests of the output and of the text restored from it."""
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS digest FROM documents),
h AS (
    SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
        list_transform([0, 8, 16, 24], lambda k: list_reduce(list_transform(range(8), lambda i: (strpos('0123456789abcdef', digest[k + i + 1]) - 1)::BIGINT), lambda x, y: 16 * x + y)) AS h
    FROM d
),
r AS (
    SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS low, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS high,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h
),
p AS (SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""
