"""Secret scans: fixed patterns, and strings in sensitive context that a primed compressor cannot shorten.

A candidate's novelty is what it adds to the compressed size of its surroundings, in bytes per
byte. The compressor is primed with a dictionary of identifiers, learned from all documents that
use sensitive words, so names, prose and repeated strings cost little and random ones cost about
as much as they are long.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and the least length of what must be long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH = 12
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_WORDS = (
    *ASSIGN_WORDS, "api key", "api-key", "access key", "access_key", "accesskey", "auth", "bearer", "certificate", "client id", "client_id", "connection string", "connectionstring",
    "credential", "login", "passphrase", "private key", "private_key", "pwd", "session id", "session_id", "sessionid", "signature", "signing key", "webhook",
)
# Parts of identifiers that code near secrets is made of; they stand before all surroundings.
IDENTIFIERS = (
    "access token refresh client secret api key private public password passwd username authorization bearer basic credentials session cookie csrf header request response config settings "
    "environment variable default example placeholder changeme your here undefined null none true false localhost http https www com org net json yaml function return import export const string number boolean"
).split()
LEARNED = 4000  # identifier parts that the dictionary learns at most; documents are counted, all of them

CANDIDATE = re.compile(r"""[^\x00-\x20"'`,;:()<>\[\]{}\x7f-\U0010ffff]{12,}""")  # quoted or not: printable ASCII without white space and brackets
_ORNAMENT = ".!?*#$%&"  # what ends a sentence or sets it off is not part of a string
_CONTEXT = re.compile("|".join(map(re.escape, CONTEXT_WORDS)), re.IGNORECASE | re.ASCII)


def learned_identifiers(docs: DataFrame, most: int = LEARNED) -> list[str]:
    """Parts of identifiers, of 3 to 11 letters, that most documents with sensitive words use, rarest first.

    Only parts that two documents or more use; they are too short to be candidates, so a secret that
    is copied does not become known as a whole.
    """
    part = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z]?[a-z]{2,10}|[A-Z]{3,11})"), F.lit(1)))).alias("part")
    text = F.lower(F.col("text"))
    sensitive = F.lit(False)
    for word in CONTEXT_WORDS:
        sensitive = sensitive | text.contains(word)
    counts = docs.select(F.col("text").cast("string").alias("text")).filter(sensitive).select(part).groupBy("part").count().filter("count > 1")
    rows = counts.orderBy(F.desc("count"), "part").limit(most).collect()
    return [r["part"] for r in reversed(rows)]


class Novelty:
    """Marginal compressed bytes of a string among its surroundings, per byte of it."""

    def __init__(self, identifiers: list[str]):
        data = " ".join(identifiers).encode() or b"\0" * 8
        self._base = " ".join(IDENTIFIERS) + " "  # so that letters have their frequencies where the surroundings are short
        primed = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._compress = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False).compress

    def __call__(self, string: str, before: str, after: str) -> float:
        around = (self._base + before + " " + after).replace(string, " ").encode()
        data = string.encode()
        return (len(self._compress(around + b" " + data)) - len(self._compress(around))) / len(data)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def novel_spans(text: str, taken: list[tuple[str, int, int]], novelty: Novelty, reach: int, around: int, least: float) -> list[tuple[str, int, int]]:
    """Strings of 12+ characters with a sensitive word less than ``reach`` before, behind or in them, outside ``taken``, of novelty ``least`` or more."""
    low = text.lower()
    if not any(word in low for word in CONTEXT_WORDS):
        return []
    starts, ends = zip(*(m.span() for m in _CONTEXT.finditer(text)), strict=True) if _CONTEXT.search(text) else ((), ())
    base = sorted((s, e) for _, s, e in taken)
    base_starts, base_ends = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    found = []
    for m in CANDIDATE.finditer(text):
        start, end = m.start(), m.start() + len(m[0].rstrip(_ORNAMENT))
        if end - start < 12:
            continue
        before, behind = bisect_right(ends, start) - 1, bisect_left(starts, start)
        if not (before >= 0 and start - ends[before] < reach or behind < len(starts) and starts[behind] - end < reach):
            continue
        overlapping = bisect_left(base_starts, end) - 1
        if overlapping >= 0 and base_ends[overlapping] > start:
            continue
        if novelty(text[start:end], text[max(0, start - around) : start], text[end : end + around]) >= least:
            found.append(("novel", start, end))
    return found


def find_secrets(docs: DataFrame, reach: int = 120, around: int = 400, least: float = 0.95) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, value) by start and then kind.

    Positions are code points, ends exclusive. Null text counts as empty; texts without secrets
    have an empty array; every row gives one row, also where doc_id is null or repeats; an empty
    table gives no rows; other columns are not read.
    """
    order = {kind: i for i, kind in enumerate(KINDS)}
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    identifiers = learned_identifiers(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low in range(0, batch.num_rows, 512):
                rows = []
                for text in texts.slice(low, 512).to_pylist():
                    text = text or ""
                    spans = base_spans(text)
                    spans += novel_spans(text, spans, novelty, reach, around, least)
                    spans.sort(key=lambda s: (s[1], order[s[0]]))
                    rows.append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for k, s, e in spans])
                yield pa.RecordBatch.from_arrays([ids.slice(low, 512), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])

    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, value: string>>")


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that ``find_secrets`` returns."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("novel"))
