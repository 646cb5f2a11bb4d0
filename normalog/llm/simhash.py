"""Operator 3, SimHash near-duplicates: BK-trees over shards of fingerprints.

Two forms share the trees. ``near_duplicates`` (op3): 64 bits over three-word shingles, repeats included, linked at 3 or
fewer differing bits. ``near_copies`` and ``keep_one`` (the pipeline's stage): 512 bits over the set of five-word
shingles, linked at 92 or fewer differing bits. That is the estimate of a Jaccard likeness of 0.8 or more: two sets of
one size and likeness s have the cosine c = 2s / (1 + s) and differ in a share of acos(c) / pi of their bits; at 0.8 that is
77.6 bits of 512 with a deviation of 8.1, so 97 of 100 pairs at exactly 0.8 are linked, nearly all above, 26 of 100 at 0.7.

Equal fingerprints are merged first, then dealt to shards so that those within the radius meet. Three bits: two
fingerprints that differ in at most ``radius`` bits agree on at least b - radius of b blocks, so each is dealt to one
shard for every choice of b - radius blocks; b is the smallest number from radius + 1 to radius + 3 whose keys are long
enough for the number of fingerprints, and the links found are the same for any b. 92 of 512 bits: no choice of blocks is
selective, so the shards are those of ``BANDS`` keys over ``ROWS`` minima of the shingle set each; sets of Jaccard
likeness s meet but for a chance of (1 - s^6)^24, 7e-4 at 0.8.

A shard's fingerprints form a BK-tree (children keyed by integer Hamming distance to their parent) and the shard's
queries follow only the edges within the radius. Fingerprints within the radius of the root are linked to it and need
no query of their own: their links to others are found from the others' side, so a group of very many near copies costs
no square of its size. Shards above ``shard_limit`` are cut into parts: each part's tree is then sent to the queries of
every later part, so no task holds an unbounded shard. A task reports a spanning forest of its links, not all pairs,
and components follow from the forests' union.

Defined results: null and blank texts have fingerprint 0 and link to each other and to others like any fingerprint;
repeated rows and ties share a component; an empty table gives no rows; other columns are not read, and stay as they
are, whatever their names, in ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normalog.llm.common import cut, partitions, small_batches, steps, table
from normalog.llm.components import components

FRONTIER = 1 << 20
#: The wide form: its words of 64 bits and radius, and the keys of its shards.
WIDE, NEAR = 8, 92
BANDS, ROWS = 24, 6
MIX = np.random.default_rng(11).integers(0, 1 << 63, (2, WIDE), np.uint64) | np.uint64(1)
TURN = np.random.default_rng(12).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32) | np.uint32(1)


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of a text's shingles of ``width`` words, A-Z lower-cased, repeats included; no words: 0."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    if len(w) < width:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, max(1, len(w) - width + 1))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Ascending distinct hashes of a text's shingles; no words: none."""
    import xxhash

    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    every = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else [b" ".join(w)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in every), np.uint64, max(1, len(w) - width + 1)))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """64 * WIDE bits of a set of hashes, as unsigned longs: a bit is 1 if set in over half of the members' hashes."""
    ones = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(h), 255):  # counts of 255 rows fit a byte
        x = h[i : i + 255, None] * MIX[0]
        x = (x ^ x >> np.uint64(32)) * MIX[1]
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)


def band_keys(h: np.ndarray) -> list[int]:
    """The set's shards: hashes of its minima, as signed longs."""
    import xxhash

    if not len(h):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    short = (h >> np.uint64(32)).astype(np.uint32)[:, None]
    for i in range(0, len(h), 2048):
        x = short[i : i + 2048] * TURN[0]
        x += TURN[1]
        low = np.minimum(low, x.min(0))
    return [xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(low.reshape(BANDS, ROWS))]


def wide_fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5) -> DataFrame:
    """(doc_id, f, keys) of every row: the wide fingerprint's words and its shards. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in steps(batch.column(2).to_pylist()):
                h = [shingle_hashes(t, width) for t in batch.column(1).slice(a, b - a).to_pylist()]
                f = pa.array([wide_fingerprint(x).view(np.int64) for x in h], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), f, pa.array([band_keys(x) for x in h], pa.list_(pa.int64()))], ["doc_id", "f", "keys"])

    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body.cast("binary").alias("b"), F.octet_length(body).alias("n")).mapInArrow(run, "doc_id long, f array<long>, keys array<long>")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in steps(batch.column(2).to_pylist()):
                fp = np.array([fingerprint(t, width) for t in batch.column(1).slice(a, b - a).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body.cast("binary").alias("b"), F.octet_length(body).alias("n")).mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, each a row of words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class BKForest:
    """One BK-tree for each group of points, built level by level for all groups at once."""

    def __init__(self, points: np.ndarray, group: np.ndarray):
        """points: rows of uint64 words, distinct within a group; group: 0..g-1, ascending."""
        n = len(points)
        self.points, self.most = points, 64 * points.shape[1]
        self.root = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.parent, self.edge = np.full(n, -1), np.full(n, -1)
        rest = np.setdiff1d(np.arange(n), self.root, assume_unique=True)
        at = self.root[group[rest]]
        while len(rest):
            d = distance(points[rest], points[at])
            slot = at * (self.most + 1) + d
            _, first, where = np.unique(slot, return_index=True, return_inverse=True)
            child = rest[first]
            self.parent[child], self.edge[child] = at[first], d[first]
            go = np.ones(len(rest), bool)
            go[first] = False
            rest, at = rest[go], child[where][go]
        # children of a node stand together, by edge
        self.order = np.lexsort((self.edge, self.parent))
        self.keys = (self.parent * (self.most + 1) + self.edge)[self.order]

    def search(self, queries: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) indices of all hits, in blocks: only edges from d - radius to d + radius are followed."""
        for a in range(0, len(queries), 2048):
            stack = [(np.arange(a, min(a + 2048, len(queries))), self.root[group[a : a + 2048]])]
            while stack:
                q, node = stack.pop()
                if len(q) > FRONTIER:
                    half = len(q) // 2
                    stack += [(q[half:], node[half:]), (q[:half], node[:half])]
                    continue
                d = distance(queries[q], self.points[node])
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                lo = np.searchsorted(self.keys, node * (self.most + 1) + np.maximum(d - radius, 0), "left")
                hi = np.searchsorted(self.keys, node * (self.most + 1) + np.minimum(d + radius, self.most), "right")
                n = hi - lo
                if n.any():
                    q = np.repeat(q, n)
                    kid = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                    stack.append((q, self.order[kid]))


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i] in place; a class's label is its smallest member."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label[:] = label[label]


def shard_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """batches: (key, part, other, node, tree, f), sorted by the first three; part's points form the tree, other's are the queries."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(map(len, held)) >= 200_000:
            t = pa.concat_tables(held)
            k = np.stack([t.column(i).to_numpy() for i in (0, 1, 2)])
            last = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0))
            if len(last):
                yield from solve_shards(t.slice(0, last[-1] + 1), radius)
                t = t.slice(last[-1] + 1)
            held = [t]
    if held:
        yield from solve_shards(pa.concat_tables(held), radius)


def solve_shards(t: pa.Table, radius: int) -> Iterator[pa.RecordBatch]:
    if not len(t):
        return
    key, part, other, node, tree = (t.column(i).to_numpy() for i in range(5))
    change = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (other[1:] != other[:-1])]
    group = np.cumsum(change) - 1
    point = t.column(5).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(t), -1)
    # groups without a tree have nothing to search
    has = np.zeros(group[-1] + 1, bool)
    has[group[tree]] = True
    index = np.cumsum(has) - 1
    nodes = np.flatnonzero(tree)
    forest = BKForest(point[nodes], index[group[nodes]])
    label = np.arange(len(t))
    root = nodes[forest.root[index[group[nodes]]]]
    near = distance(point[nodes], point[root]) <= radius
    merge_labels(label, nodes[near], root[near])
    # what is near its own tree's root need not ask: whoever else is near it asks
    asks = has[group] & (~tree | (part == other))
    asks[nodes[near]] = False
    queries = np.flatnonzero(asks)
    for q, hit in forest.search(point[queries], index[group[queries]], radius):
        merge_labels(label, queries[q], nodes[hit])
    linked = np.flatnonzero(label != np.arange(len(t)))
    if len(linked):
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], ["a", "b"])


def block_masks(bits: int) -> list[int]:
    edges = [round(i * 64 / bits) for i in range(bits + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def links(fps: DataFrame, radius: int = 3, shard_limit: int = 8192) -> DataFrame:
    """(a, b) links that span the same components as all pairs of fps within the radius. fps: distinct fp."""
    n = fps.count()
    bits = next((b for b in (radius + 1, radius + 2) if n < 64 << (64 * (b - radius) // b)), radius + 3)
    masks = block_masks(bits)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [signed(sum(c)) for c in combinations(masks, bits - radius)]
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in chosen))).alias("k", "v"))
    return links_in_shards(keyed.select(F.xxhash64("k", "v").alias("key"), F.col("fp").alias("node")), None, radius, shard_limit)


def links_in_shards(keyed: DataFrame, points: DataFrame | None, radius: int, shard_limit: int) -> DataFrame:
    """(a, b): nodes linked within shards. keyed: key (the shard), node, distinct; points: node, f (the fingerprint's words), or the nodes are the points."""
    spark = keyed.sparkSession
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a hash shared by two keys only adds candidates
    sized = keyed.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / shard_limit).cast("int"))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    # fingerprints join only what shares its shard
    sized = sized.join(points, "node") if points else sized.withColumn("f", F.array("node"))
    # to its part's tree in the tasks of all later parts, and as a query to all earlier trees
    tree = F.transform(F.sequence(F.col("own"), F.col("parts") - 1), lambda o: F.struct(F.col("own").alias("part"), o.alias("other"), F.lit(True).alias("tree")))
    query = F.transform(F.filter(F.sequence(F.lit(0), F.col("own")), lambda p: p < F.col("own")), lambda p: F.struct(p.alias("part"), F.col("own").alias("other"), F.lit(False).alias("tree")))
    rows = sized.select("key", "node", "f", F.explode(F.concat(tree, query)).alias("x")).select("key", "x.part", "x.other", "node", "x.tree", "f")
    ordered = rows.repartition(partitions(spark), "key", "part", "other").sortWithinPartitions("key", "part", "other", "node")
    return ordered.mapInArrow(lambda it: shard_links(it, radius), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable over links."""
    own = cut(fingerprints(docs, text, id_col, width))
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), radius))
    return own.join(smallest_ids(classes, "fp", roots), "fp").select("doc_id", "fp", "component_id")


def smallest_ids(classes: DataFrame, name: str, roots: DataFrame) -> DataFrame:
    """(name, component_id): of each class the smallest id of all classes in its component. classes: name, least."""
    rooted = classes.join(roots, F.col(name) == F.col("node"), "left").select(name, "least", F.coalesce("root", name).alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select(name, "root").join(best, "root").select(name, "component_id")


def near_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shard_limit: int = 8192) -> DataFrame:
    """(doc_id, component_id) of every row with an id: linked by wide fingerprints that differ in at most NEAR bits."""
    own = wide_fingerprints(docs.where(F.col(id_col).isNotNull()), text, id_col)
    own = cut(own.withColumn("cls", F.xxhash64("f", "keys")))
    classes = cut(own.groupBy("cls").agg(F.min("doc_id").alias("least"), F.first("f").alias("f"), F.first("keys").alias("keys")))
    # equal fingerprints meet too, whatever their minima
    keyed = classes.select(F.explode(F.array_distinct(F.concat("keys", F.array(F.xxhash64("f"))))).alias("key"), F.col("cls").alias("node"))
    found = components(links_in_shards(keyed, classes.select(F.col("cls").alias("node"), "f"), NEAR, shard_limit))
    return own.select("doc_id", "cls").join(smallest_ids(classes.select("cls", "least"), "cls", found), "cls").select("doc_id", "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose component of near copies has a smaller id; of rows with one id and text, one stays.

    Rows of one id with different texts are one document: they stay or go together. Rows with a null id have no order
    among themselves and are kept.
    """
    found = cut(near_copies(docs, text, id_col))
    # texts of one id may lie in several components
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"))
    repeated = not ids.where("n > 1").isEmpty()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    kept = rows.join(ids.where("stays = 1").select(F.col("doc_id").alias("id")), "id", "left_semi")
    kept = kept.dropDuplicates(["id", "t"]) if repeated else kept
    return kept.select("row").unionByName(rows.where("id IS NULL").select("row")).select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
