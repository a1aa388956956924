"""SimHash near-duplicates found in BK-trees.

Two searches share fingerprints, trees and components. `near_duplicates` links fingerprints of three-word shingles at
RADIUS bits. `similar_texts` links texts whose sets of five-word shingles have a Jaccard similarity of LEAST or more.

A document's fingerprint takes the majority of each bit over the XXH64 of its word shingles. Equal fingerprints
are folded before any search. Fingerprints within radius 2 agree on at least two of four 16-bit blocks, so each
goes to six tables keyed by a pair of blocks; the tree of a key holds what shares it, children keyed by their
integer Hamming distance to the parent, and a search follows only edges within the radius. A key with more
fingerprints than a tree may hold is dealt into several trees, each searched by every other share of the key, so
a task's group stays bounded and no link is lost. A search reports one link for each set that a tree's own links
already join, never all pairs. Components of the links are found by rounds over written tables.

For similar texts the fingerprint is the majority over the distinct shingles, as the similarity is of sets: a text with one word
repeated many times after it is still near the text. The two majorities of a pair of similarity 0.8 are decided by shared
shingles but for a fifth, so a bit differs with a probability of 0.15, or at most 0.19 in sets of five: ten to twelve bits
on average, and more than WIDE_RADIUS in two pairs of a million at worst. At such a distance no choice of blocks keys a useful
table. The tables are keyed by BANDS groups of ROWS minima of the shingles' hashes instead, of which a pair of similarity 0.8
shares one but for 3 in 100,000. What a tree finds within WIDE_RADIUS is confirmed by the exact Jaccard similarity in the
task itself, where the texts' shingles are at hand, unless the two are joined already. A first round in FIRST of the tables,
share by share, joins most copies; the second takes the keys of all tables that still hold texts of different components,
every share of a key with every other one. So a link is missed only by these two chances, however many texts there are.

Defined results
- Null text counts as empty; no words give fingerprint zero, which links like any other.
- Fewer words than a shingle has make one shingle of the whole sequence.
- Repeated rows are each returned. A null doc_id never names a component unless all its ids are null.
- An empty table gives an empty result. Only the id and text columns are read.
- For similar texts, texts of equal words are copies, null and empty ones too. Rows are told apart by doc_id and text. Of a
  component the least row stays, by doc_id (null last), then by the text's hash.
"""

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, free_name
from .graph import connected_components

SHINGLE, SEED, RADIUS, BLOCKS, TREE_NODES = 3, 42, 2, 4, 2048
#: For similar texts: shingle, similarity, tables, minima in a key, tables of the first round.
WIDE_SHINGLE, LEAST, BANDS, ROWS, FIRST = 5, 0.8, 20, 4, 2
#: Widest distance at which a tree's finds are compared (see above); most texts and shingles in a share.
WIDE_RADIUS, SHARE, SHARE_SHINGLES = 28, 1024, 1 << 21
_ODD = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """The words, A-Z lower-cased, joined by blanks, and the XXH64 of each shingle in order, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(line, SEED)] if words else []
    else:
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        hashes = [h(line[s : e - 1], SEED) for s, e in zip(starts, starts[shingle:], strict=False)]
    return line, np.array(hashes, dtype="<u8")


def majority(of: np.ndarray) -> int:
    """Unsigned 64 bits: those set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(of), 65536):
        ones += np.unpackbits(of[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(of), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the text."""
    return majority(shingle_hashes(text, shingle)[1])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t.as_py(), shingle)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Integers under Hamming distance; equal ones are kept once."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        value, children = self.root
        while d := (x ^ value).bit_count():
            if d not in children:
                children[d] = (x, {})
                return
            value, children = children[d]

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (x ^ value).bit_count()
            if d <= radius:
                found.append(value)
            if len(children) <= 2 * radius:
                todo += [child for e, child in children.items() if -radius <= e - d <= radius]
            else:
                todo += [children[e] for e in range(max(d - radius, 1), d + radius + 1) if e in children]
        return found


class Sets:
    """Disjoint sets of whatever is asked for, each its own at first."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def top(self, x):
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x, y) -> bool:
        """Whether they were apart."""
        x, y = self.top(x), self.top(y)
        self.parent[x] = y
        return x != y


def tree_links(nodes: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join every query, and every node, with whatever lies within the radius among the nodes."""
    tree, sets, links = BKTree(), Sets(), []

    def join(x: int) -> None:
        links.extend((x, y) for y in tree.within(x, radius) if sets.join(x, y))

    for x in nodes:
        join(x)
        tree.add(x)
    for x in queries:
        join(x)
    return links


def _places():
    """Where a row of share `own` out of `shares` goes: to the trees it is a node of, one for each share that asks, and as a query to others'."""
    as_node = F.transform(F.sequence("own", F.col("shares") - 1), lambda q: F.struct(F.col("own").alias("tree"), q.alias("asker"), F.lit(True).alias("node")))
    as_query = F.when(F.col("own") > 0, F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda j: F.struct(j.alias("tree"), F.col("own").alias("asker"), F.lit(False).alias("node"))))
    return F.concat(as_node, F.coalesce(as_query, F.array().cast("array<struct<tree:int,asker:int,node:boolean>>")))


def near_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Distinct fp -> links (a, b) whose components are those of all pairs within the radius."""
    width = 64 // blocks
    masks = [_signed(sum(((1 << width) - 1) << (width * i) for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = durable(keyed.groupBy("t", "key").count().filter("count > 1"), "bk_sizes")
    sized = keyed.join(sizes, ["t", "key"]).withColumn("shares", F.ceil(F.col("count") / tree_nodes).cast("int"))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int"))
    dealt = sized.select("t", "key", "fp", F.explode(_places()).alias("g")).select("t", "key", "g.tree", "g.asker", "g.node", "fp")
    group = ["t", "key", "tree", "asker"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, queries, out = None, [], [], []

        def flush() -> None:
            if at is not None:
                full = lambda xs: [x & (1 << 64) - 1 for x in xs]
                out.extend(tree_links(full(nodes), full(queries), radius))

        for b in batches:
            c = [x.to_pylist() for x in b.columns]
            for t, key, tree, asker, node, fp in zip(*c, strict=True):
                if (t, key, tree, asker) != at:
                    flush()
                    at, nodes, queries = (t, key, tree, asker), [], []
                (nodes if node else queries).append(fp)
            if out:
                yield _pairs(out)
                out.clear()
        flush()
        if out:
            yield _pairs(out)

    def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_signed(p[k]) for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach."""
    prints = durable(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fps")
    labels = connected_components(near_links(fps))
    named = fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = durable(named, "labelled_fps")
    least = durable(named.groupBy("label").agg(F.min("least").alias("component_id")), "component_ids")
    found = durable(named.select("fp", "label").join(least, "label").select("fp", "component_id"), "fp_components")
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def band_keys(of: np.ndarray) -> bytes:
    """BANDS keys of 8 bytes, each from ROWS minima of the hashes under odd multipliers."""
    least = np.full(len(_ODD), ~np.uint64(0))
    for k in range(0, len(of), 1024):
        np.minimum(least, (of[k : k + 1024, None] * _ODD).min(axis=0), out=least)
    rows = (least >> np.uint64(32)).reshape(BANDS, ROWS) * _ODD[:ROWS]
    return (np.bitwise_xor.reduce(rows ^ (rows >> np.uint64(29)), axis=1) * _ODD[0]).astype("<u8").tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """docs (doc_id, t, text) -> doc_id, t, node (hash of the words), n (distinct shingles), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, bands = [], [], []
            for text in b.column(2):
                line, of = shingle_hashes(text.as_py(), WIDE_SHINGLE)
                of = np.unique(of)
                node.append(_signed(xxhash.xxh64_intdigest(line, SEED)))
                n.append(len(of))
                bands.append(band_keys(of))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(bands, pa.binary())], ["doc_id", "t", "node", "n", "bands"])

    return docs.mapInArrow(run, "doc_id long, t long, node long, n int, bands binary")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """texts (node, text) -> node, fp (the majority over the distinct shingles), of (their hashes, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_hashes(t.as_py(), WIDE_SHINGLE)[1] for t in b.column(1)]
            found = [np.unique(x) for x in found]
            fps, sets = [_signed(majority(x)) for x in found], [x.tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), pa.array(sets, pa.binary())], ["node", "fp", "of"])

    return texts.mapInArrow(run, "node long, fp long, of binary")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of LEAST or more."""
    small, large = sorted((x, y), key=len)
    if len(small) < LEAST * len(large):
        return False
    if not len(large):
        return True
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return both >= LEAST * (len(x) + len(y) - both)


def wide_links(nodes: list[tuple], queries: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links of (node, label, fp, set) rows: every node and query with what is similar to it among the nodes, one for each set it joins."""
    tree, sets, at = BKTree(), Sets(), {}
    for i, (node, label, fp, of) in enumerate(nodes + queries):
        for f in tree.within(fp, WIDE_RADIUS):
            for other, other_label, its in at[f]:
                if sets.top(label) != sets.top(other_label) and similar(of, its):
                    sets.join(label, other_label)
                    yield node, other
        if i < len(nodes):
            tree.add(fp)
            at.setdefault(fp, []).append((node, label, of))


def band_links(rows: DataFrame, sets: DataFrame, across: bool) -> DataFrame:
    """rows (band, key, node, label, own, shares) -> links (a, b) of nodes; across: between a key's shares, not only within them."""
    places = _places() if across else F.array(F.struct(F.col("own").alias("tree"), F.col("own").alias("asker"), F.lit(True).alias("node")))
    dealt = rows.select("band", "key", "node", "label", F.explode(places).alias("g")).select("band", "key", "g.tree", "g.asker", F.col("g.node").alias("is_node"), "node", "label")
    group = ["band", "key", "tree", "asker"]
    dealt = dealt.join(sets, "node").select(*group, "is_node", "node", "label", "fp", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, queries = None, [], []

        def links() -> pa.RecordBatch:
            out = list(wide_links(nodes, queries))
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], ["a", "b"])

        for b in batches:
            for *of, is_node, node, label, fp, its in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if of != at:
                    yield links()
                    at, nodes, queries = of, [], []
                (nodes if is_node else queries).append((node, label, fp & (1 << 64) - 1, np.frombuffer(its, "<u8")))
        yield links()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long").distinct()


def similar_texts(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """slim (doc_id, t, text) -> nodes (node, least: the row that stands for it), labels (node, label) of the components of more than one."""
    rows = durable(sketches(slim), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    nodes = durable(rows.groupBy("node").agg(F.min(place).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    discard(rows)
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.substring("bands", 8 * k + 1, 8).alias("key")) for k in range(BANDS)])
    keyed = durable(nodes.select("node", "n", F.explode(bands).alias("k")).select("node", "n", "k.band", "k.key"), "band_keys")
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("many"), F.sum("n").alias("shingles")).filter("many > 1")
    shares = F.greatest(F.ceil(F.col("many") / SHARE), F.ceil(F.col("shingles") / SHARE_SHINGLES)).cast("int")
    sizes = durable(sizes.select("band", "key", shares.alias("shares")), "band_sizes")
    own = F.pmod(F.xxhash64("node", "band"), F.col("shares")).cast("int").alias("own")
    met = durable(keyed.join(sizes, ["band", "key"]).select("band", "key", "node", own, "shares"), "band_rows")
    # the text of a node is that of its least row
    linked = nodes.join(met.select("node").distinct(), "node").select("node", F.struct("least.doc_id", "least.t").alias("__key"))
    texts = slim.select(F.struct("doc_id", "t").alias("__key"), "text").join(durable(linked, "met_nodes"), "__key").dropDuplicates(["node"])
    sets = durable(shingle_sets(texts.select("node", "text")), "shingle_sets")
    first = durable(band_links(met.filter(F.col("band") < FIRST).withColumn("label", F.col("node")), sets, False), "first_links")
    labels = connected_components(first).select(F.col("node").alias("__n"), "label")
    named = met.join(labels, met["node"] == F.col("__n"), "left").select("band", "key", "node", "own", "shares", F.coalesce("label", "node").alias("label"))
    named = durable(named, "named_rows")
    apart = named.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band", "key")
    rest = durable(named.join(durable(apart, "keys_apart"), ["band", "key"]), "rows_apart")
    links = durable(first.union(band_links(rest, sets, True)), "similar_links")
    return nodes, connected_components(links)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The least row of each component of similar texts, with all columns; rows that repeat both doc_id and text come back once."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    nodes, labels = similar_texts(slim)
    named = durable(nodes.select(F.col("node").alias("n"), "least").join(labels, F.col("n") == labels["node"], "left").select("least", F.coalesce("label", "n").alias("label")), "named_nodes")
    kept = durable(named.groupBy("label").agg(F.min("least").alias("least")).select(F.struct("least.doc_id", "least.t").alias("__kept")), "kept_rows")
    key = free_name(docs, "__key")
    marked = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t")))
    return marked.join(kept, marked[key] == kept["__kept"], "left_semi").dropDuplicates([key]).drop(key)
