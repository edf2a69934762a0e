"""Near-duplicate documents by chosen-path set similarity join.

Documents are sets of word shingles with a signature of minwise tokens. Each tree sends a document
from a node to one child per selected token, named by that token, so similar documents stay
together with high probability. Small nodes are compared exhaustively; large ones branch again.
Independent trees are repeated until the target recall is reached. Every link is confirmed on the
full sets, and links are closed to components.

Documents with equal sets are one from the start. In every node, members are first compared with
the node's smallest id; a group of near copies, however large, is then mostly one component, and
nodes whose members are all in one component need nothing more.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.components import connected_components
from massloom.llm.shingles import MinHash, shingle_set
from massloom.session import Scratch

TOKENS = 128
LEAF_ROWS = 1000
DEPTH = 2
BRANCHES = 3  # selected tokens per node
SHINGLES = 16_000_000  # of unpacked sets that a task holds
DEVIATIONS = 4.5  # how far below the threshold, in standard deviations, a signature may be


def trees_for(similarity: float, recall: float, depth: int = DEPTH, branches: int = BRANCHES) -> int:
    """Trees that a pair of just this similarity needs to share a leaf with probability ``recall``."""
    reach = 1.0
    for level in range(depth, 0, -1):  # from the lowest level up; the root selects one token more
        reach = 1 - (1 - similarity * reach) ** (branches if level == 1 else branches - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - reach)))


def least_match(similarity: float) -> float:
    """Share of equal tokens below which a pair cannot well have ``similarity``."""
    return similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / TOKENS)


def _text_key(text: str) -> str:
    """What tells the texts of one doc_id apart."""
    return hashlib.md5(text.encode()).hexdigest()


def _features(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = MinHash(TOKENS)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                ids, texts = batch.column(0).slice(low, 256), batch.column(1).slice(low, 256)
                sizes, keys, tokens, digests = [], [], [], []
                for text in texts:
                    text = text.as_py() or ""
                    values = shingle_set(text, width)
                    digests.append(_text_key(text))
                    sizes.append(len(values))
                    keys.append(xxhash.xxh3_128_digest(values.tobytes()))
                    tokens.append(sign(values).tobytes() if len(values) else None)
                columns = [ids, pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "set_key", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text_key string, n_shingles long, set_key binary, tokens binary")


def _branch(rows: DataFrame, level: int, trees: int) -> DataFrame:
    """(node, id) of the children: of rows (id, tokens) at the root, of rows (node, id, tokens) further down."""
    root = level == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
            tokens = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("tokens")).to_pylist()), np.uint32).reshape(-1, TOKENS)
            parents = None if root else batch.column(batch.schema.get_field_index("node")).to_numpy(zero_copy_only=False).view(np.uint64)
            for pick in range(trees * BRANCHES if root else BRANCHES - 1):
                if root:  # trees take disjoint tokens
                    place = np.full(len(ids), pick)
                    seed = np.full(len(ids), pick + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                else:
                    seed = (parents ^ np.uint64(pick + 1 + 16 * level)) * np.uint64(0xD6E8FEB86659FD93)
                    seed ^= seed >> np.uint64(32)
                    place = (seed % np.uint64(TOKENS - trees * BRANCHES)).astype(np.int64) + trees * BRANCHES
                node = (seed ^ tokens[np.arange(len(ids)), place]) * np.uint64(0xFF51AFD7ED558CCD)
                node ^= node >> np.uint64(33)
                node *= np.uint64(0xC4CEB9FE1A85EC53)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids)], ["node", "id"])

    return rows.mapInArrow(run, "node long, id long")


def _groups(batches: Iterator[pa.RecordBatch], key: str = "node") -> Iterator[pa.Table]:
    """The rows of each key, one table at a time, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for low, high in zip(edges, edges[1:], strict=False):
            if held and held[-1].column(batch.schema.get_field_index(key))[0].as_py() != keys[low]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


class _Forest:
    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(label, i) for i, label in enumerate(labels)]

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _candidate_groups(rows: DataFrame, similarity: float) -> DataFrame:
    """(node, id, component, sketch): within each node of rows (node, id, component, sketch), the groups that sketches tie together.

    Rows whose sketch agrees with no row of another component go. Groups are named by their ids, so
    the same group found in several nodes is one.
    """
    least = least_match(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            ids, components = table.column("id").to_numpy(), table.column("component").to_numpy()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), TOKENS)
            forest, tied = _Forest(list(range(len(ids)))), np.zeros(len(ids), bool)
            for i in range(len(ids) - 1):
                match = (sketches[i + 1 :] == sketches[i]).mean(axis=1)
                for j in np.flatnonzero((match >= least) & (components[i + 1 :] != components[i])) + i + 1:
                    forest.join(i, int(j))
                    tied[i] = tied[j] = True
            names = np.zeros(len(ids), np.int64)
            tops = np.array([forest.top(i) for i in range(len(ids))])
            for top in np.unique(tops[tied]):
                group = np.flatnonzero(tops == top)
                names[group] = np.int64(xxhash.xxh3_64_intdigest(np.sort(ids[group]).tobytes()) >> 1)
            keep = pa.array(np.flatnonzero(tied))
            out = table.select(["id", "component", "sketch"]).take(keep)
            if out.num_rows:
                yield from out.add_column(0, "node", pa.array(names[tied])).to_batches()

    ordered = rows.select("node", "id", "component", "sketch").repartition("node").sortWithinPartitions("node")
    return ordered.mapInArrow(run, "node long, id long, component long, sketch binary").dropDuplicates(["node", "id"])


def _packed_texts(docs: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, packed) of the members that ``ids`` names, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                ids_, texts = batch.column(0).slice(low, 512), [t.as_py() or "" for t in batch.column(1).slice(low, 512)]
                keys = pa.array(map(_text_key, texts), pa.string())
                yield pa.RecordBatch.from_arrays([ids_, keys, pa.array([pack(t.encode()) for t in texts], pa.binary())], ["doc_id", "text_key", "packed"])

    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text_key string, packed binary")
    wanted = members.select("id", "doc_id", "text_key").join(ids.select("id").distinct().hint("merge"), "id", "left_semi")  # ids grow with the documents
    found = packed.join(wanted.hint("merge"), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])  # rows may be repeated
    return found.select("id", "packed")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _unpack(packed: bytes, width: int) -> np.ndarray:
    return shingle_set(zstandard.ZstdDecompressor().decompress(packed).decode(), width)


class _Sets:
    """Sets of packed texts, of which those used last stay unpacked while they have ``SHINGLES`` shingles or fewer together."""

    def __init__(self, packed: list[bytes], width: int):
        self._packed, self._width = packed, width
        self._held: dict[int, np.ndarray] = {}
        self._size = 0

    def __getitem__(self, i: int) -> np.ndarray:
        found = self._held.pop(i, None)
        if found is None:
            found = _unpack(self._packed[i], self._width)
            self._size += len(found)
        self._held[i] = found
        while self._size > SHINGLES and len(self._held) > 2:
            self._size -= len(self._held.pop(next(iter(self._held))))
        return found


def _confirmed_pairs(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            a, b, pa_, pb = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                if b[i] != last:
                    last, last_set = b[i], _unpack(pb[i], width)
                if _similar(_unpack(pa_[i], width), last_set, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("packed_a")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("packed").alias("packed_b")), "b")
    return both.select("a", "b", "packed_a", "packed_b").mapInArrow(run, "a long, b long")


def _confirmed_groups(groups: DataFrame, texts: DataFrame, width: int, similarity: float, percent: int) -> DataFrame:
    """Links (a, b) that join the components inside each group of rows (node, id, component, sketch)."""
    least = least_match(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            ids, components = table.column("id").to_pylist(), table.column("component").to_pylist()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), TOKENS)
            packed = table.column("packed").to_pylist()
            sets = _Sets(packed, width)
            forest, links = _Forest(components), []
            for i in range(len(ids) - 1):
                match = (sketches[i + 1 :] == sketches[i]).mean(axis=1)
                close = np.flatnonzero(match >= least)
                for j in close[np.argsort(-match[close], kind="stable")] + i + 1:
                    if forest.top(i) != forest.top(int(j)) and _similar(sets[i], sets[j], percent):
                        forest.join(i, int(j))
                        links.append((ids[i], ids[j]))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = groups.join(texts, "id").select("node", "id", "component", "sketch", "packed")
    return rows.repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "a long, b long")


def _sketch(tokens: Column | str) -> Column:
    """The low byte of each token."""
    text = F.hex(tokens)  # eight digits a token, least significant byte first
    return F.unhex(F.regexp_replace(text, "(..)......", "$1"))


def _linked_sets(docs: DataFrame, width: int, similarity: float, recall: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of all rows, the members (id, doc_id, text_key, set_key, ...), one for each distinct set of shingles, and links (a, b) between members.

    A member's doc_id is the smallest of the rows with its set. Members have ids of their own, as
    rows that repeat a doc_id may have different sets.
    """
    percent = round(100 * similarity)
    trees = trees_for(similarity, recall)
    features = scratch.keep(_features(docs, width), "features")

    with_words = features.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = with_words.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("set_key", "first.*")
    rows = with_words.select("set_key", "doc_id", "text_key", "tokens").join(first.hint("merge"), ["set_key", "doc_id", "text_key"], "left_semi").dropDuplicates(["set_key"])
    # Numbered once, as the table is written; from here on a member's id is what the table says.
    members = scratch.keep(rows.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text_key", "set_key", "tokens", _sketch("tokens").alias("sketch")), "members")

    def known_nodes(rows: DataFrame, components: DataFrame | None, name: str) -> DataFrame:
        """Rows of nodes that hold more than one component, with the size of the node and its smallest id."""
        if components is not None:
            rows = rows.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
        else:
            rows = rows.withColumn("component", F.col("id"))
        rows = scratch.keep(rows, f"{name}-rows")
        mixed = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("pivot"), F.min("component").alias("low"), F.max("component").alias("high"))
        mixed = scratch.keep(mixed.filter("low < high").select("node", "n", "pivot"), f"{name}-nodes")
        out = scratch.keep(rows.join(mixed, "node"), f"{name}-mixed")
        scratch.drop(rows, mixed)
        return out

    root = known_nodes(_branch(members.select("id", "tokens"), 0, trees), None, "root")
    pairs = root.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    side = lambda name: members.select(F.col("id").alias(name), F.col("sketch").alias(f"sketch_{name}"))
    pairs = _agreeing(pairs.join(side("a"), "a").join(side("b"), "b"), least_match(similarity))
    pairs = scratch.keep(pairs, "pairs")
    texts = scratch.keep(_packed_texts(docs, members, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))), "texts")
    links = scratch.keep(_confirmed_pairs(pairs, texts, width, percent), "links")
    scratch.drop(texts)

    components = scratch.keep(connected_components(links, scratch), "components")
    rows, leaves = known_nodes(root.select("node", "id"), components, "level-1"), []
    for level in range(1, DEPTH):
        leaves.append(rows.filter(F.col("n") <= LEAF_ROWS).select("node", "id", "component"))
        large = rows.filter(F.col("n") > LEAF_ROWS)
        if large.isEmpty():
            break
        large = large.join(members.select("id", "tokens"), "id").select("node", "id", "tokens")
        rows = known_nodes(_branch(large, level, trees), components, f"level-{level + 1}")
    leaves.append(rows.filter(F.col("n") <= LEAF_ROWS).select("node", "id", "component"))
    leaves.append(_blocks(rows.filter(F.col("n") > LEAF_ROWS)))
    small = leaves[0]
    for more in leaves[1:]:
        small = small.union(more)
    groups = scratch.keep(_candidate_groups(small.join(members.select("id", "sketch"), "id"), similarity), "groups")
    texts = scratch.keep(_packed_texts(docs, members, groups.select("id")), "more-texts")
    more = scratch.keep(_confirmed_groups(groups, texts, width, similarity, percent), "more-links")
    scratch.drop(texts, groups)

    return features, members, links.union(more)


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.99999) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id and kept.

    Documents with Jaccard similarity of their ``width``-word shingles of ``similarity`` or more are
    linked; a component is named by its smallest doc_id, and that document is kept. Null texts and
    texts without words have no shingles and are linked with nothing. A null doc_id is a component
    of its own; rows that repeat a doc_id are one document: each row's links count, and all get the
    component that these tie together. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    features, members, links = _linked_sets(docs, width, similarity, recall, scratch)
    named = lambda name: members.select(F.col("id").alias(name), F.col("doc_id").alias(f"doc_{name}"))
    links = links.join(named("a"), "a").join(named("b"), "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    with_words = features.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "set_key")
    equal = with_words.join(members.select("set_key", F.col("doc_id").alias("b")), "set_key").select(F.col("doc_id").alias("a"), "b").filter("a <> b").distinct()
    final = connected_components(links.filter("a <> b").union(equal), scratch)
    labelled = features.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return labelled.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _agreeing(pairs: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, TOKENS) for i in (2, 3))
            keep = pa.array((one == other).mean(axis=1) >= least)
            yield batch.select(["a", "b"]).filter(keep)

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    """Nodes that stay large at the last level, as pairs of blocks: every two members meet in one, and none is larger than two blocks."""
    blocks = F.ceil(F.col("n") / LEAF_ROWS).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    met = rows.withColumn("own", own).withColumn("blocks", blocks).withColumn("other", other)
    return met.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id", "component")


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.99999) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest doc_id; all columns stay.

    Rows without text, words or doc_id stay. Here each text counts by itself: of rows that repeat a
    doc_id with different texts, those that no other kept text is linked with stay; rows that repeat
    both stay or go together. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    features, members, links = _linked_sets(docs, width, similarity, recall, scratch)
    final = connected_components(links, scratch)
    placed = members.select("id", "doc_id", "text_key").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    stay = placed.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    with_words = features.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "text_key").distinct()
    gone = with_words.join(stay.hint("merge"), ["doc_id", "text_key"], "left_anti").select(F.col("doc_id").alias("id"), "text_key")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # whatever the columns are called
    text_key = F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    return rows.join(gone.hint("merge"), (F.col("row.doc_id") == F.col("id")) & (text_key == F.col("text_key")), "left_anti").select("row.*")
