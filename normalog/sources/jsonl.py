"""JSON-lines sources and sinks: items, traces and their checkpoints, graded output, episodes, manifests.

Readers take a schema, so nothing is scanned for inference and unused fields are never parsed; ``.gz`` files are read by
suffix. Blank lines are skipped. Broken lines read as rows of nulls.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normalog.plans import library
from normalog.sources import scratch


def read_items(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_logs(spark: SparkSession, folder: str, schema: str | T.StructType) -> DataFrame:
    """One JSON document a file, all files of a folder."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows with file and line_at, by which lines of one file sort as they stand in it.

    line_at pairs the split's offset with the row's number in its task; a split is read by one task, in order.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("line_at"))
    return raw.where(F.trim("value") != "").select("file", "line_at", F.from_json("value", schema).alias("r")).select("file", "line_at", "r.*")


def last_wins(lines: DataFrame, key: str = "id") -> DataFrame:
    """The last line of each key within its file order; files follow one another by name."""
    rest = [c for c in lines.columns if c not in ("file", "line_at")]
    return lines.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rest), F.struct("file", "line_at")).alias("r")).select("r.*")


def only_traced(items: DataFrame, trace: DataFrame, key: str = "id") -> DataFrame:
    """Items whose key occurs in the trace. The optimizer broadcasts the keys where their size allows."""
    return items.join(trace.select(key).distinct(), key, "left_semi")


def supersede(final: DataFrame, part: DataFrame, key: str = "id") -> DataFrame:
    """Final rows, and checkpoint rows of keys that have no final row; partial tells them apart."""
    rest = part.join(final.select(key).distinct(), key, "left_anti")
    return final.withColumn("partial", F.lit(False)).unionByName(rest.withColumn("partial", F.lit(True)))


def append_steps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of a key as one: steps concatenated in line order, costs and numbers of compactions added."""
    held = F.sort_array(F.collect_list(F.struct("file", "line_at", "steps")))
    return rows.groupBy(*keys).agg(F.flatten(F.transform(held, lambda r: r["steps"])).alias("steps"), F.sum("cost").alias("cost"), F.sum("compactions").alias("compactions"))


def one_item(items: DataFrame, wanted: str, key: str = "id") -> DataFrame:
    """The one row of a key; running it fails if there is none or more than one."""
    rows = items.where(F.col(key) == wanted)
    n = rows.limit(2).agg(F.count(F.lit(1)).alias("_n"))
    checked = n.select(F.when(F.col("_n") == 1, F.lit(wanted)).otherwise(F.raise_error(F.concat(F.lit(f"{wanted}: rows found: "), F.col("_n").cast("string")))).alias("_wanted"))
    # the checked value stands for the key, so that the check cannot be pruned away
    return checked.join(rows, F.col(key) == F.col("_wanted"), "left").select(*(F.col("_wanted").alias(key) if c == key else c for c in items.columns))


def field_names(t: T.DataType) -> set[str]:
    if isinstance(t, T.StructType):
        return {f.name for f in t} | {n for f in t for n in field_names(f.dataType)}
    if isinstance(t, T.ArrayType):
        return field_names(t.elementType)
    return field_names(t.valueType) if isinstance(t, T.MapType) else set()


#: Fields that only the graded side may see.
LABELS = ("licensed", "licensed_names", "violating", "violating_names", "compliant", "compliant_names", "blamed", "stale_trap", "flip", "difficulty")
#: Item fields the blind view leaves out.
HIDDEN = ("timeline", "events", "motifs", "base_rules", "allow", "sort", "goal", "contexts", "universe", "seed", "meta", "signature", "probe_pool")


def refuse_labels(items: DataFrame, path: str = "") -> DataFrame:
    """items, or ValueError if the file's name or any field, however deep, tells of labels."""
    found = field_names(items.schema) & set(LABELS)
    if "full" in os.path.basename(path) or found:
        raise ValueError(f"labels may leak: {path or sorted(found)}")
    return items


def blind(items: DataFrame) -> DataFrame:
    """Items without what reveals labels; turns keep text and probe_id, probes what they show."""

    def keep(x: Column, names: tuple[str, ...], has: T.StructType) -> Column:
        return F.struct(*(x[n].alias(n) for n in names if n in has.fieldNames()))

    out = items.drop(*HIDDEN)
    if "sessions" in out.columns:
        turn = out.schema["sessions"].dataType.elementType["turns"].dataType.elementType
        out = out.withColumn("sessions", F.transform("sessions", lambda s: F.struct(s["index"].alias("index"), F.transform(s["turns"], lambda t: keep(t, ("text", "probe_id"), turn)).alias("turns"))))
    if "probes" in out.columns:
        probe = out.schema["probes"].dataType.elementType
        out = out.withColumn("probes", F.transform("probes", lambda p: keep(p, ("probe_id", "session", "options", "option_names", "params"), probe)))
    return out


def write_graded(graded: DataFrame, summary: DataFrame, path: str) -> None:
    """Graded rows as JSON lines, then one line with the summary in the last file."""
    rows = graded.select(F.to_json(F.struct(*graded.columns)).alias("value"))
    last = summary.select(F.to_json(F.struct(F.struct(*summary.columns).alias("__summary__"))).alias("value"))
    rows.unionByName(last.coalesce(1)).write.text(path)


def write_episodes(items: DataFrame, path: str, key: str = "id") -> None:
    """One gzipped file an episode. An episode is one task's work; episodes spread over all tasks."""
    items.repartition(key).write.partitionBy(key).option("compression", "gzip").json(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """First 16 hex digits of the SHA-256 of every file, compressed as it stands."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json.gz").load(folder)
    return files.select("path", "length", F.substring(F.sha2("content", 256), 1, 16).alias("sha256"))


def not_done(jobs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def seeds_not_done(jobs: DataFrame, done: DataFrame, width: int = 20) -> DataFrame:
    """Jobs with no done seed in [seed, seed + width), by an equi-join on blocks of that width."""
    block = F.floor(F.col("seed") / width)
    reach = done.select(F.col("seed").alias("_done"), F.explode(F.array(block - 1, block)).alias("_block"))
    mine = jobs.withColumn("_at", block)
    return mine.join(reach, (F.col("_at") == F.col("_block")) & F.col("_done").between(F.col("seed"), F.col("seed") + width - 1), "left_anti").drop("_at")


WEIGHTED = "SELECT ep, probe, weight, span_tier FROM weighted"
DONE_SEEDS = "SELECT DISTINCT event_id AS seed FROM ev WHERE event_id % 97 = 0"
JOBS = "SELECT event_id AS seed, ep FROM ev"


def jsonl_gz_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted probes, written as one gzipped file an episode and read again."""
    path = scratch.folder(spark, "episodes")
    rows = library.run(spark, sf_dir, WEIGHTED)
    write_episodes(rows, path, "ep")
    return read_items(spark, path, "probe long, weight decimal(38,3), span_tier string, ep long").select("ep", "probe", F.col("weight").cast(rows.schema["weight"].dataType).alias("weight"), "span_tier")


def trace_file_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks written as lines in the order they were made; the last of each option key stays."""
    path = scratch.folder(spark, "trace")
    rows = library.run(spark, sf_dir, "SELECT concat(ep, '/', option_key) AS id, ep, option_key, pick, ord FROM probes")
    rows.repartition("ep").sortWithinPartitions("ord").drop("ord").write.json(path)
    return last_wins(read_lines(spark, path, "id string, ep long, option_key int, pick long")).select("ep", "option_key", "pick")


def resume_seed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds_not_done(library.run(spark, sf_dir, JOBS), library.run(spark, sf_dir, DONE_SEEDS))


QUERIES = {f.__name__: f for f in (jsonl_gz_roundtrip, trace_file_last_wins, resume_seed_blocks)}
SQL = {
    "jsonl_gz_roundtrip": WEIGHTED,
    "trace_file_last_wins": "SELECT ep, option_key, max_by(pick, ord) AS pick FROM probes GROUP BY ep, option_key",
    "resume_seed_blocks": f"SELECT j.seed, j.ep FROM ({JOBS}) j WHERE NOT EXISTS (SELECT 1 FROM ({DONE_SEEDS}) d WHERE d.seed BETWEEN j.seed AND j.seed + 19)",
}
