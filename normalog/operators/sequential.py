"""Operators whose next step depends on what they kept: greedy selection, non-contiguous keeping, buffered flushing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normalog.plans import library

PICK = "ep long, probe long, sess long, place long"


def greedy_select(features: DataFrame, k: int = 6, bands: tuple[float, ...] = (1 / 3, 2 / 3), shares: tuple[float, ...] = (0.2, 0.3, 0.5)) -> DataFrame:
    """Per episode: third by third its quota, each time the probe of the highest score given those already chosen.

    Ties go to the smaller probe id; one probe a session. An episode's probes are the bounded unit of work.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        last = pdf["sess"].max() + 1
        pdf = pdf.assign(band=(pdf["sess"] / last > bands[0]).astype(int) + (pdf["sess"] / last > bands[1]).astype(int)).sort_values("probe")
        quotas = [round(k * s) for s in shares[:-1]]
        quotas.append(k - sum(quotas))
        chosen: list = []
        for band, quota in enumerate(quotas):
            for _ in range(quota):
                tests, used = [c.event_type for c in chosen], {c.sess for c in chosen}
                traps = sum(c.is_trap for c in chosen)
                rest = [r for r in pdf[pdf["band"] == band].itertuples() if r.sess not in used]
                if not rest:
                    break
                value = lambda r: 1.2 * r.is_trap + r.weight + 0.5 * (r.span_tier == "far") - 0.7 * tests.count(r.event_type) - 2.5 * (r.is_trap and traps >= round(0.7 * k))  # noqa: B023, E731
                chosen.append(max(rest, key=lambda r: (value(r), -r.probe)))  # noqa: B023
        return pd.DataFrame([(c.ep, c.probe, c.sess, i) for i, c in enumerate(chosen)], columns=["ep", "probe", "sess", "place"])

    return features.groupBy("ep").applyInPandas(pick, PICK)


def keep_skipping(turns: DataFrame, limit: int) -> DataFrame:
    """Newest to oldest, keep what still fits and go on past what does not: (conv_id, turn, kept)."""
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n"))), asc=False).alias("t"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<turn:bigint,kept:boolean>>").alias("out"))

    def step(a, x):
        fits = a["used"] + x["n"] <= limit
        return F.struct((a["used"] + F.when(fits, x["n"]).otherwise(0)).alias("used"), F.concat(a["out"], F.array(F.struct(x["turn"].cast("long").alias("turn"), fits.alias("kept")))).alias("out"))

    return rows.select("conv_id", F.explode(F.aggregate("t", start, step)["out"]).alias("x")).select("conv_id", "x.turn", "x.kept")


def flush_buffer(turns: DataFrame, cap: int) -> DataFrame:
    """Number of the flush each turn goes out with: before a turn that would overflow the buffer, and once it is full."""
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    start = F.struct(F.lit(0).alias("held"), F.lit(0).alias("flush"), F.array().cast("array<struct<turn:bigint,flush:int>>").alias("out"))

    def step(a, x):
        over = (a["held"] > 0) & (a["held"] + x["n"] > cap)
        flush = a["flush"] + F.when(over, 1).otherwise(0)
        held = F.when(over, x["n"]).otherwise(a["held"] + x["n"])
        return F.struct(F.when(held >= cap, 0).otherwise(held).alias("held"), (flush + F.when(held >= cap, 1).otherwise(0)).alias("flush"), F.concat(a["out"], F.array(F.struct(x["turn"].cast("long").alias("turn"), flush.alias("flush")))).alias("out"))

    return rows.select("conv_id", F.explode(F.aggregate("t", start, step)["out"]).alias("x")).select("conv_id", "x.turn", "x.flush")


def select_probes_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_select(library.run(spark, sf_dir, "SELECT ep, probe, cast(sess AS bigint) AS sess, event_type, is_trap, weight, span_tier FROM weighted"))


def greedy_keep_noncontiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_skipping(spark.read.parquet(f"{sf_dir}/conversations.parquet"), 1500)


def buffered_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flush_buffer(spark.read.parquet(f"{sf_dir}/conversations.parquet"), 1000)


def solve_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode's last rule base with bodies, context facts, and an alias rule, solved at once."""
    from normalog.operators import solve

    last = library.run(spark, sf_dir, "SELECT ep, rid, ent, neg, prio, body FROM timeline WHERE valid_to = 1000000 AND NOT retracted")
    head = F.concat(F.when(F.col("neg"), "~").otherwise(""), F.lit("allow(e"), "ent", F.lit(")"))
    own = last.select(F.col("ep").alias("key"), "rid", head.alias("head"), F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.array("body")).alias("body"), "prio")
    keys = last.select(F.col("ep").alias("key")).distinct()
    fixed = [("ctx", "ctx0", [], 1), ("feasible", "task_feasible", ["allow(?X)"], 1), ("alias", "allow(e0)", ["allow(e1)"], 1), ("alias_neg", "~allow(e0)", ["~allow(e1)"], 2)]
    rules = own.unionByName(keys.select("key", F.explode(F.array(*(F.struct(F.lit(r).alias("rid"), F.lit(h).alias("head"), F.array(*map(F.lit, b)).cast("array<string>").alias("body"), F.lit(p).cast("long").alias("prio")) for r, h, b, p in fixed))).alias("x")).select("key", "x.*"))
    universe = keys.select("key", F.lit("option").alias("sort"), F.explode(F.array(*(F.lit(f"e{i}") for i in range(8)))).alias("const"))
    signature = spark.createDataFrame([("allow", ["option"])], "pred string, sorts array<string>")
    closure, verdict = solve.solve(solve.ground(rules, universe, signature))
    return verdict.join(closure.groupBy("key").agg(F.count(F.lit(1)).alias("n_literals")), "key", "left").select(F.col("key").alias("ep"), "converged", "rounds", "n_literals")


QUERIES = {f.__name__: f for f in (select_probes_greedy, greedy_keep_noncontiguous, buffered_flush, solve_converged)}
