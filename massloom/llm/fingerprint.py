"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame operations only.

Leaves are blocks, runs of at most 64 characters that end with a sentence; a paragraph (line) is
hashed from the hashes of its blocks, a section from those of its paragraphs, the root from those
of its sections. A paragraph whose hash begins with 0 to 3 closes a section, so an edit moves no
borders but its own. The fingerprint is the tree as text:

    root|section:paragraph.block.block,paragraph.block;section:paragraph.block

Roots test equality. Likeness and the search for edits go down the tree, into differing branches only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.session import shuffle_width

BLOCK = r"[^.!?]{1,64}[.!?]*|[.!?]+"


def fingerprint(text: Column) -> Column:
    """The tree of a text; null counts as empty, and the empty text has one empty paragraph."""

    def node(leaves: Column) -> Column:
        own = F.md5(F.array_join(leaves, ""))
        shown = F.array_join(F.transform(leaves, lambda b: F.concat(F.lit("."), F.substring(b, 1, 12))), "")
        return F.concat(own, shown, F.when(F.substring(own, 1, 1) < "4", F.lit(";")).otherwise(F.lit(",")))

    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(BLOCK), F.lit(0)), F.md5)
    paragraphs = F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), leaves)
    flat = F.array_join(F.transform(paragraphs, node), "")
    sections = F.split(F.regexp_replace(flat, "[,;]$", ""), ";")
    named = F.transform(sections, lambda s: F.concat(F.substring(F.md5(s), 1, 16), F.lit(":"), s))
    root = F.sha2(F.array_join(F.transform(sections, F.md5), ""), 256)
    return F.concat(root, F.lit("|"), F.array_join(named, ";"))


def sections_of(print_: Column) -> Column:
    """The section subtrees of a fingerprint."""
    return F.split(F.substring_index(print_, "|", -1), ";")


def paragraphs_of(sections: Column) -> Column:
    """The paragraph subtrees below section subtrees."""
    return F.flatten(F.transform(sections, lambda s: F.split(F.substring_index(s, ":", -1), ",")))


def blocks_of(subtrees: Column) -> Column:
    """The block hashes below subtrees."""
    return F.regexp_extract_all(F.array_join(subtrees, ","), F.lit(r"\.([0-9a-f]{12})"), F.lit(1))


def likeness(one: Column, other: Column) -> Column:
    """Share of blocks that two trees have in common; 1 for equal roots, 0 where neither has a block in a differing branch or in common.

    Equal sections count with all their blocks. Only differing sections are opened, and of their
    paragraphs only differing ones, whose blocks are compared as sets. The share is twice the common
    blocks over the sum of both sides.
    """
    tops = F.struct(sections_of(one).alias("a"), sections_of(other).alias("b"))

    def opened(pair: Column) -> tuple[Column, Column, Column]:
        return F.array_intersect(pair["a"], pair["b"]), F.array_except(pair["a"], pair["b"]), F.array_except(pair["b"], pair["a"])

    def within(pair: Column, deeper: Callable[[Column, Column], Column]) -> Column:
        """(common, all) blocks, all counted on both sides."""
        same, left, right = opened(pair)
        equal = F.size(blocks_of(same))
        # One element, so that what is below is evaluated once for each level.
        return F.element_at(F.transform(F.array(deeper(left, right)), lambda d: F.struct((equal + d["common"]).alias("common"), (2 * equal + d["all"]).alias("all"))), 1)

    def of_blocks(left: Column, right: Column) -> Column:
        a, b = F.array_distinct(blocks_of(left)), F.array_distinct(blocks_of(right))
        return F.struct(F.size(F.array_intersect(a, b)).alias("common"), (F.size(a) + F.size(b)).alias("all"))

    def of_paragraphs(left: Column, right: Column) -> Column:
        pair = F.array(F.struct(paragraphs_of(left).alias("a"), paragraphs_of(right).alias("b")))
        return F.element_at(F.transform(pair, lambda p: within(p, of_blocks)), 1)

    found = F.element_at(F.transform(F.array(tops), lambda p: within(p, of_paragraphs)), 1)
    share = F.element_at(F.transform(F.array(found), lambda f: F.when(f["all"] == 0, F.lit(0.0)).otherwise(2.0 * f["common"] / f["all"])), 1)
    return F.when(F.substring(one, 1, 64) == F.substring(other, 1, 64), F.lit(1.0)).otherwise(share)


def differing_paragraphs(old: Column, new: Column) -> Column:
    """Paragraph hashes of ``new`` that stand in sections which ``old`` lacks, and that ``old`` itself lacks."""
    hashes = lambda sections: F.transform(paragraphs_of(sections), lambda p: F.substring(p, 1, 32))
    return F.array_except(hashes(F.array_except(sections_of(new), sections_of(old))), hashes(sections_of(old)))


def _cell(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are below ``key``, looked up in two steps of about a square root each."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b < key))
    coarse = below(F.array(*(F.lit(g[0]).cast("long") for g in groups)))
    nested = F.array(*(F.array(*(F.lit(b).cast("long") for b in g)) for g in groups))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + below(F.element_at(nested, coarse)))


def with_next(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """``rows`` with, for each ``columns`` item (name: new name), its value in the next row by ``key``; the first follows the last.

    Rows go to cells of neighbouring keys whose bounds are quantiles, in one shuffle; the rows with
    a cell's least key stand in the cell before as well, so that every row meets its successor
    without a global order in one task. What reaches the driver is one key per cell. Rows that
    share a key follow one another; null keys come first.
    """
    spark = rows.sparkSession
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    cells = 4 * shuffle_width(spark)
    quantiles = rows.select(order.alias("k")).agg(F.percentile_approx("k", [i / cells for i in range(1, cells)], 10 * cells).alias("q")).first()["q"] or []
    bounds = sorted(set(quantiles))
    firsts = rows.select(order.alias("k")).groupBy(_cell(F.col("k"), bounds).alias("cell")).agg(F.min("k").alias("first")).orderBy("cell").collect()
    if not firsts:
        return rows.select("*", *(F.col(c).alias(new) for c, new in columns.items()))
    size = len(bounds) + 1
    first, before = [None] * size, [0] * size
    for i, r in enumerate(firsts):
        first[r["cell"]], before[r["cell"]] = r["first"], firsts[i - 1]["cell"]
    start = firsts[0]["cell"]
    at = F.col("__cell") + 1
    is_first = F.col("__key") == F.element_at(F.array(*(F.lit(x).cast("long") for x in first)), at)
    lead_in = F.struct(F.element_at(F.array(*(F.lit(x) for x in before)), at).alias("cell"), (F.col("__cell") == start).alias("wraps"), F.lit(True).alias("guest"))
    own = F.struct(F.col("__cell").alias("cell"), F.lit(False).alias("wraps"), F.lit(False).alias("guest"))
    placed = rows.withColumn("__key", order).withColumn("__cell", _cell(F.col("__key"), bounds))
    placed = placed.withColumn("__at", F.explode(F.when(is_first, F.array(own, lead_in)).otherwise(F.array(own)))).drop("__cell")
    tie = [F.col(c) for c in columns]
    within = Window.partitionBy("__at.cell").orderBy(F.col("__at.wraps"), F.col("__at.guest"), F.col("__key"), *tie)
    return placed.select("*", *(F.lead(c).over(within).alias(new) for c, new in columns.items())).filter("NOT __at.guest").drop("__at", "__key")


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or
    all, of the next document. Null text counts as empty; rows that repeat a doc_id follow one
    another; a single row is its own next; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("fingerprint", fingerprint(F.col("text")))
    paired = with_next(rows, "doc_id", {"text": "next_text", "fingerprint": "next_fingerprint"})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    made = made.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def _duck_print(text: str) -> str:
    return f"""(SELECT sha256(list_aggregate(list_transform(s, lambda x: md5(x)), 'string_agg', '')) || '|' || list_aggregate(list_transform(s, lambda x: md5(x)[1:16] || ':' || x), 'string_agg', ';')
  FROM (SELECT string_split(regexp_replace(list_aggregate(list_transform(list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{BLOCK}'), lambda b: md5(b))),
    lambda p: md5(coalesce(array_to_string(p, ''), '')) || coalesce(list_aggregate(list_transform(p, lambda b: '.' || b[1:12]), 'string_agg', ''), '')
      || CASE WHEN md5(coalesce(array_to_string(p, ''), ''))[1] < '4' THEN ';' ELSE ',' END),
    'string_agg', ''), '[,;]$', ''), ';') AS s))"""


#: The oracle keeps nodes as rows of one table (side, level, hash, blocks below) and counts common subtrees from the top down.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
e AS (SELECT doc_id, n, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nxt FROM d),
f AS (SELECT doc_id, n, text, nxt, substring(text, 1, n - n // 2) || substring(nxt, 1, n // 2) AS edited FROM e),
g AS (SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_duck_print("text")} AS fingerprint, {_duck_print("edited")} AS edited_fingerprint, {_duck_print("nxt")} AS next_fingerprint FROM f),
pairs AS (SELECT doc_id, 'e' AS other, fingerprint AS a, edited_fingerprint AS b FROM g UNION ALL SELECT doc_id, 'n', fingerprint, next_fingerprint FROM g),
s AS (SELECT DISTINCT doc_id, other, 'a' AS side, unnest(string_split(a[66:], ';')) AS section FROM pairs UNION SELECT doc_id, other, 'b', unnest(string_split(b[66:], ';')) FROM pairs),
sc AS (SELECT doc_id, other, section, count(*) AS sides, min(side) AS side FROM s GROUP BY ALL),
s_same AS (SELECT doc_id, other, sum(len(regexp_extract_all(section, '\\.[0-9a-f]{{12}}'))) AS same FROM sc WHERE sides = 2 GROUP BY ALL),
p AS (SELECT DISTINCT doc_id, other, side, unnest(string_split(section[18:], ',')) AS paragraph FROM sc WHERE sides = 1),
pc AS (SELECT doc_id, other, paragraph, count(*) AS sides, min(side) AS side FROM p GROUP BY ALL),
p_same AS (SELECT doc_id, other, sum(len(regexp_extract_all(paragraph, '\\.[0-9a-f]{{12}}'))) AS same FROM pc WHERE sides = 2 GROUP BY ALL),
b AS (SELECT DISTINCT doc_id, other, side, unnest(regexp_extract_all(paragraph, '\\.[0-9a-f]{{12}}')) AS block FROM pc WHERE sides = 1),
bc AS (SELECT doc_id, other, block, count(*) AS sides FROM b GROUP BY ALL),
b_same AS (SELECT doc_id, other, sum(sides) AS n_all, sum(CASE WHEN sides = 2 THEN 1 ELSE 0 END) AS same FROM bc GROUP BY ALL),
near AS (SELECT pairs.doc_id, pairs.other, CASE WHEN a[1:64] = b[1:64] THEN 1.0
    WHEN 2 * coalesce(s_same.same, 0) + 2 * coalesce(p_same.same, 0) + coalesce(b_same.n_all, 0) = 0 THEN 0.0
    ELSE 2.0::DOUBLE * (coalesce(s_same.same, 0) + coalesce(p_same.same, 0) + coalesce(b_same.same, 0)) / (2 * coalesce(s_same.same, 0) + 2 * coalesce(p_same.same, 0) + coalesce(b_same.n_all, 0)) END::DOUBLE AS near
  FROM pairs LEFT JOIN s_same USING (doc_id, other) LEFT JOIN p_same USING (doc_id, other) LEFT JOIN b_same USING (doc_id, other))
SELECT g.*  EXCLUDE (next_fingerprint), e.near AS near_edited, n.near AS near_next
FROM g JOIN near e ON e.doc_id = g.doc_id AND e.other = 'e' JOIN near n ON n.doc_id = g.doc_id AND n.other = 'n'
"""
