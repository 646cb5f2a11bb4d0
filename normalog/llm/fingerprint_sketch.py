"""Operator 2 (native), document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct XXH64 hashes of a text's shingles of five words (fewer words: the whole
sequence; none: an empty sketch). Sketches of parts merge into that of the whole by ``merge_sketches``;
``resemblance``, ``containment`` and ``distinct_shingles`` estimate from sketches alone. ``sketch_groups`` merges by a
key of any skew: partial merges under a salt come first.

Defined results: null texts are empty; two empty sketches resemble each other fully (1.0), an empty and another not at
all; rows with equal ids follow each other by their text's hash; a null id comes first; a lone row is its own next.
An empty table gives no rows; columns beside id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from normalog.llm.common import partitions, table, words

K, WIDTH = 128, 5


def let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """Ascending array of the k smallest shingle hashes."""

    def of(h: Column) -> Column:
        n = F.greatest(F.size(h) - width + 1, F.least(F.size(h), F.lit(1)))
        shingle = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(width)))
        hashes = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(1), n), shingle)
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def merge_sketches(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: of the union's k smallest hashes, the share that both sketches hold."""
    shared = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)
    return let(merge_sketches(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(shared(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; from there on (k - 1) over the k-th hash's place in the hash range."""
    full = (F.lit(k - 1) / ((F.get(a, F.lit(k - 1)).cast("double") + 2.0**63) / 2.0**64)).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(full)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: J * |a or b| / |a|."""
    union = merge_sketches(a, b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_shingles(union, k) / distinct_shingles(a, k)))


def sketch_groups(docs: DataFrame, key: str, text: str = "text", k: int = K, width: int = WIDTH, salts: int = 64) -> DataFrame:
    """(key, sketch) of each key's texts together. Hashes are first cut to k distinct per key and salt, then per key."""
    h = docs.select(F.col(key).alias("key"), F.pmod(F.xxhash64(F.col(text)), F.lit(salts)).alias("salt"), F.explode_outer(sketch(F.col(text), k, width)).alias("h")).distinct()
    low = h.withColumn("r", F.row_number().over(W.partitionBy("key", "salt").orderBy("h"))).where(F.col("r") <= k)
    return low.groupBy("key").agg(F.slice(F.sort_array(F.collect_set("h")), 1, k).alias("sketch"))


def with_next(rows: DataFrame, order: list[str], fields: list[str], buckets: int) -> DataFrame:
    """rows with next, a struct of fields of the row that follows by order (a long, then tie-breakers); after the last, the first.

    Buckets are cut at quantiles that are values of the data; a bucket also gets a copy of the row that starts the one
    after it, so that a window in each bucket, and no window over all, finds every successor.
    """
    key = order[0]
    q = rows.agg(F.percentile_approx(key, F.array(*(F.lit(i / buckets) for i in range(buckets))), F.lit(10_000)).alias("q"), F.min(key).alias("low")).first()
    if q["q"] is None:
        return rows.withColumn("next", F.struct(*fields))
    starts = sorted({q["low"], *q["q"]})
    edge = F.array(*(F.lit(x) for x in starts[1:])).cast("array<bigint>")
    own = F.size(F.filter(edge, lambda x: x <= F.col(key)))
    copies = F.array_compact(F.array(F.struct(own.alias("bucket"), F.lit(0).alias("ghost")), F.when(F.array_contains(edge, F.col(key)), F.struct((own - 1).alias("bucket"), F.lit(1).alias("ghost"))), F.when(F.col(key) == F.lit(starts[0]), F.struct(F.lit(len(starts) - 1).alias("bucket"), F.lit(2).alias("ghost")))))
    spread = rows.withColumn("_c", F.explode(copies)).withColumns({"_b": F.col("_c.bucket"), "_g": F.col("_c.ghost")}).drop("_c")
    w = W.partitionBy("_b").orderBy("_g", *order)
    return spread.withColumn("next", F.lead(F.struct(*fields)).over(w)).where("_g = 0").drop("_b", "_g")


def hexed(s: Column) -> Column:
    return F.lower(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = K, width: int = WIDTH) -> DataFrame:
    """Every row's fingerprint, its edited text's, and their likenesses."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumns({"_k": F.coalesce("doc_id", F.lit(-(2**63))), "_h": F.xxhash64("t"), "s": sketch(F.col("t"), k, width)})
    rows = with_next(rows, ["_k", "_h"], ["t", "s"], 3 * partitions(spark))
    n = F.char_length("t")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("e", F.concat(F.substring("t", F.lit(1), n - half), F.substring("next.t", F.lit(1), half)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), "s", sketch(F.col("e"), k, width).alias("es"), F.col("next.s").alias("ns"))
    return rows.select("doc_id", "n_chars", "edited_sha256", hexed(F.col("s")).alias("fingerprint"), hexed(F.col("es")).alias("edited_fingerprint"), resemblance(F.col("s"), F.col("es"), k).alias("near_edited"), resemblance(F.col("s"), F.col("ns"), k).alias("near_next"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
