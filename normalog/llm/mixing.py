"""Operator 4 (native), mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Sources, ordered by code point with null last, weigh 1, 2, 3 and again; targets share the corpus's words by weight,
none above ``most`` times its source's words (the excess is reshared). A source's documents fall into blocks of about
``block_docs`` by a hash of their id, into ``MOST_BLOCKS`` larger ones at most, so that neither the draws of the tree's
root nor the blocks' table grow without end; blocks are permuted by another hash. The mix takes whole epochs of all blocks,
then the permuted blocks in turn while they fit the rest of the target, and of the next block the documents that still
fit, largest first. So every source's taken words end below its target by less than the smallest document left over.

Block quotas are exact. The tree splits them among ``shards`` output shards: at each node half of all draws go left,
and how many of each source do is a hypergeometric draw (an urn emptied by hashed uniforms). A shard then owns a
disjoint run of each source's permuted draws and orders its documents by a hash. Everything hangs on hashes of ids, so
reruns agree whatever the partitioning.

Null texts have size 0 (taken 0). Null sources form the last source. Rows repeated with one id and size are taken
together. Sources are few against documents: one row each is all that meets in a window or an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from normalog.llm.common import cut, table, words

SOURCE = ["_null", "_source"]
MOST_BLOCKS = 65_536
#: Bytes counted before a table is broadcast; with more, the join shuffles.
BROADCAST_BYTES = 16 << 20


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row a source: n, words, weight, target. sizes: _null, _source, size."""
    every = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = sizes.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("_null", "_source")) - 1
    s = s.withColumn("weight", F.array(*map(F.lit, weights))[place % len(weights)]).withColumn("cap", most * F.col("words"))
    # capped sources are the first by cap / weight: each is reached by the level that the ones before it leave
    before = W.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), *SOURCE).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("words").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("capped", F.col("weight") * left >= F.col("cap") * open_weight)
    rest = F.sum("words").over(every) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    shared = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * rest / shared)
    return s.withColumn("target", target).select(*SOURCE, "n", "words", "weight", "target")


def urn_step(salt):
    """Draws one source's share of the left half: an urn of rest draws, left of which go left."""

    def one(a, s):
        def urn(b, i):
            u = F.pmod(F.xxhash64(salt, F.col("node"), s["_null"], s["_source"], i), b["rest"])
            k = F.when(u < b["left"], 1).otherwise(0).cast("long")
            return F.struct((b["rest"] - 1).alias("rest"), (b["left"] - k).alias("left"), (b["k"] + k).alias("k"))

        draws = F.when(s["q"] > 0, F.sequence(F.lit(1).cast("long"), s["q"])).otherwise(F.array().cast("array<bigint>"))
        b = F.aggregate(draws, F.struct(a["rest"].alias("rest"), a["left"].alias("left"), F.lit(0).cast("long").alias("k")), urn)
        # transform over one element names the urn's end, so that it is drawn once
        got = lambda b: F.array(F.struct(s["_null"].alias("_null"), s["_source"].alias("_source"), b["k"].alias("k"), s["q"].alias("q")))
        return F.transform(F.array(b), lambda b: F.struct(b["rest"].alias("rest"), b["left"].alias("left"), F.concat(a["out"], got(b)).alias("out")))[0]

    return one


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Exact quotas q of each source among shards (a power of two). quotas: _null, _source, q."""
    level = quotas.select(F.lit(0).alias("node"), F.struct(*SOURCE, F.col("q").cast("long").alias("q")).alias("s")).groupBy("node").agg(F.sort_array(F.collect_list("s")).alias("s"))
    depth = shards.bit_length() - 1
    for d in range(depth):
        salt = F.lit(seed * 64 + d)

        one = urn_step(salt)
        total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["q"])
        empty = F.array().cast("array<struct<_null:boolean,_source:string,k:bigint,q:bigint>>")
        start = F.struct(total.alias("rest"), F.floor((total + 1) / 2).cast("long").alias("left"), empty.alias("out"))
        out = level.select("node", F.aggregate("s", start, one)["out"].alias("o"))
        halves = F.explode(
            F.array(
                F.struct((2 * F.col("node")).alias("node"), F.transform("o", lambda x: F.struct(x["_null"].alias("_null"), x["_source"].alias("_source"), x["k"].alias("q"))).alias("s")),
                F.struct((2 * F.col("node") + 1).alias("node"), F.transform("o", lambda x: F.struct(x["_null"].alias("_null"), x["_source"].alias("_source"), (x["q"] - x["k"]).alias("q"))).alias("s")),
            )
        )
        level = out.select(halves.alias("h")).select("h.node", "h.s")
    return level.select(F.col("node").alias("shard"), F.explode("s").alias("s")).select("shard", "s._null", "s._source", "s.q")


def sized(docs: DataFrame, text: str, id_col: str, source: str) -> DataFrame:
    """docs with _id, _null, _source and size (words)."""
    return docs.withColumns({"_id": F.col(id_col).cast("long"), "_null": F.col(source).isNull(), "_source": F.coalesce(F.col(source).cast("string"), F.lit("")), "_size": F.size(words(F.col(text))).cast("long")})


def block_of(n, block_docs: int, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col("_id"), F.col("size")), F.greatest(F.lit(1), F.least(F.ceil(n / block_docs), F.lit(MOST_BLOCKS))))


def block_plan(sizes: DataFrame, shards: int, seed: int, block_docs: int, most: int, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks). sources: targets, n, and where their draws go; blocks: what is taken of each. sizes is read several times."""
    src = cut(targets(sizes, most, weights))
    placed = sizes.join(src.select(*SOURCE, "n"), SOURCE).withColumn("block", block_of(F.col("n"), block_docs, seed))
    blocks = placed.groupBy(*SOURCE, "block").agg(F.sum("size").alias("block_words")).join(src, SOURCE)
    turn = W.partitionBy(*SOURCE).orderBy(F.xxhash64(F.lit(seed + 1), F.col("block")), "block")
    whole = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long")
    blocks = blocks.withColumns({"rank": F.row_number().over(turn) - 1, "upto": F.sum("block_words").over(turn), "epochs": whole, "n_blocks": F.count(F.lit(1)).over(W.partitionBy(*SOURCE))})
    rest = F.col("target") - F.col("epochs") * F.col("words")
    blocks = blocks.withColumns({"full": F.col("upto") <= rest, "part": (F.col("upto") > rest) & (F.col("upto") - F.col("block_words") <= rest), "room": rest - F.col("upto") + F.col("block_words")})
    blocks = cut(blocks.withColumn("full", F.col("full") & (F.col("words") > 0)).withColumn("part", F.col("part") & (F.col("words") > 0)))
    # of the one block cut through, the documents that fit, largest first
    units = placed.join(blocks.where("part").select(*SOURCE, "block", "room"), [*SOURCE, "block"]).groupBy(*SOURCE, "block", "room", "_id", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("w"))
    listed = units.groupBy(*SOURCE, "block", "room").agg(F.sort_array(F.collect_list(F.struct("w", "_id", "size")), asc=False).alias("u"))
    none = F.struct(F.col("room"), F.array().cast("array<struct<_id:bigint,size:bigint>>").alias("got"))
    fit = F.aggregate("u", none, lambda a, x: F.when(x["w"] <= a["room"], F.struct((a["room"] - x["w"]).alias("room"), F.concat(a["got"], F.array(F.struct(x["_id"].alias("_id"), x["size"].alias("size")))).alias("got"))).otherwise(a))
    chosen = listed.select(*SOURCE, "block", fit["got"].alias("chosen"))
    drawn = cut(blocks.groupBy(*SOURCE).agg(F.first("epochs").alias("epochs"), F.first("n_blocks").alias("n_blocks"), (F.first("epochs") * F.first("n_blocks") + F.sum((F.col("full") | F.col("part")).cast("long"))).alias("q")))
    runs = split(drawn.select(*SOURCE, "q"), shards, seed).withColumn("end", F.sum("q").over(W.partitionBy(*SOURCE).orderBy("shard")))
    ends = runs.groupBy(*SOURCE).agg(F.sort_array(F.collect_list("end")).alias("ends"))
    sources = src.select(*SOURCE, "n", "words", "target").join(drawn.drop("q"), SOURCE).join(ends, SOURCE)
    return cut(sources), cut(blocks.join(chosen, [*SOURCE, "block"], "left").select(*SOURCE, "block", "rank", "full", "chosen"))


def few(df: DataFrame, items: str) -> DataFrame:
    """df, to be broadcast if its bytes allow; items: its array column."""
    size = df.agg(F.sum(64 + F.octet_length("_source") + 16 * F.greatest(F.size(items), F.lit(0)).cast("long")).alias("b")).first()["b"]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def place(rows: DataFrame, plan: tuple[DataFrame, DataFrame], seed: int, block_docs: int) -> DataFrame:
    """rows (with _id, _null, _source, size) and source_size, target, taken, placements (epoch, shard, local order)."""
    src, blocks = plan
    out = rows.join(few(src, "ends"), SOURCE).withColumn("block", block_of(F.col("n"), block_docs, seed)).join(few(blocks, "chosen"), [*SOURCE, "block"])
    extra = F.col("full") | F.coalesce(F.exists("chosen", lambda x: x["_id"].eqNullSafe(F.col("_id")) & (x["size"] == F.col("size"))), F.lit(False))
    copies = F.col("epochs") + F.when(extra, 1).otherwise(0)
    shard = lambda e: F.size(F.filter("ends", lambda x: x <= e * F.col("n_blocks") + F.col("rank")))
    spots = F.transform(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<bigint>")), lambda e: F.struct(e.alias("epoch"), shard(e).alias("shard"), F.xxhash64(F.lit(seed + 2), F.col("_id"), e).alias("order")))
    out = out.withColumns({"source_size": F.col("words"), "taken": F.col("size") * copies, "placements": spots})
    return out.drop("n", "block", "words", "epochs", "n_blocks", "rank", "full", "chosen", "ends")


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", shards: int = 16, seed: int = 17, block_docs: int = 512, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source_size, target, taken, placements of every row."""
    rows = cut(sized(docs.select(F.col(id_col).alias("_i"), F.col(text).alias("_t"), F.col(source).alias("_s")), "_t", "_i", "_s").select("_id", *SOURCE, F.col("_size").alias("size")))
    out = place(rows, block_plan(rows, shards, seed, block_docs, most, weights), seed, block_docs)
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken", "placements")


def mixed(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", shards: int = 16, seed: int = 17, block_docs: int = 512, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: docs' rows with all their columns, as often as taken, dealt to their shards and shuffled there."""
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_t"), F.col(id_col).alias("_i"), F.col(source).alias("_s"))
    rows = sized(packed, "_t", "_i", "_s").select("_row", "_id", *SOURCE, F.col("_size").alias("size"))
    sizes = cut(rows.select("_id", *SOURCE, "size"))
    out = place(rows, block_plan(sizes, shards, seed, block_docs, most, weights), seed, block_docs)
    dealt = out.select("_row", F.explode("placements").alias("p")).repartition("p.shard").sortWithinPartitions("p.shard", "p.order")
    return dealt.select("_row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.transform("placements", lambda p: p["shard"]).alias("shards"))
