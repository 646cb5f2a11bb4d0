"""Scenarios: motif chains dealt to episodes, interleaved, laid out in sessions, labelled by solving, and padded.

All episodes are made at once by joins with the small table of scripts. Random choices are hashes of the seed and a
row's own keys, so a rerun, on any number of tasks, gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from normalog.operators import scripts, solve

NAMES = 96
SLOTS = "xyzw"


def draw(seed: int, *of: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *of)


def motif_chains(spark: SparkSession, episodes: DataFrame, chains: int = 6, seed: int = 1) -> DataFrame:
    """(ep, chain, motif, ents, grp): chains of an episode share no entity; the last is a canary.

    episodes: ep. Entities are a permutation of the names, four to a chain, so chains is at most 24.
    """
    if not 1 <= chains * len(SLOTS) <= NAMES:
        raise ValueError("an episode holds 1 to 24 chains")
    motif = F.get(F.array(*map(F.lit, scripts.NAMES)), F.pmod(draw(seed, "ep", "chain"), F.lit(len(scripts.NAMES))).cast("int"))
    # a step without a common divisor with 96 visits every name once
    step = F.get(F.array(*(F.lit(s) for s in range(1, NAMES, 2) if s % 3)), F.pmod(draw(seed, "ep", F.lit("step")), F.lit(32)).cast("int"))
    place = lambda j: F.pmod(draw(seed, "ep") + (F.col("chain") * len(SLOTS) + j) * step, F.lit(NAMES))
    ents = F.array(*(F.format_string("e%02d", place(j) + 1) for j in range(len(SLOTS))))
    dealt = episodes.select("ep").distinct().select("ep", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("chain"))
    return dealt.select("ep", "chain", F.when(F.col("chain") == chains - 1, "canary").otherwise(motif).alias("motif"), ents.alias("ents"), F.concat(F.lit("g"), F.pmod(draw(seed, "ep", "chain", F.lit("g")), F.lit(6)) + 1).alias("grp"))


def filled(text: Column) -> Column:
    """A script's literal with the chain's entities, group and contexts."""
    for j, s in enumerate(SLOTS):
        text = F.regexp_replace(text, F.lit(rf"\b{s}\b"), F.get("ents", F.lit(j)))
    text = F.regexp_replace(text, F.lit(r"\bg\b"), F.col("grp"))
    return F.regexp_replace(text, F.lit(r"\b(c[12])\b"), F.concat(F.lit("$1_m"), F.col("chain").cast("string")))


def interleave_beats(spark: SparkSession, chains: DataFrame, cycles: int = 1, seed: int = 1, per_session: int = 2) -> DataFrame:
    """(ep, chain, motif, ents, grp, beat_no, beat, tests, options, side, pos, session), pos in the episode's order.

    Every interleaving that keeps chains in order is equally likely: beats draw keys, and a chain's keys, sorted, go to
    its beats in order.
    """
    table = spark.createDataFrame(scripts.rows(cycles)[0], scripts.BEATS)
    beats = chains.join(table, "motif").withColumn("key", draw(seed, "ep", "chain", "beat_no"))
    chain = W.partitionBy("ep", "chain")
    slots = beats.select("ep", "chain", "key", (F.row_number().over(chain.orderBy("key")) - 1).alias("beat_no"))
    placed = beats.drop("key").join(slots, ["ep", "chain", "beat_no"])
    pos = F.row_number().over(W.partitionBy("ep").orderBy("key", "chain", "beat_no")) - 1
    return placed.withColumn("pos", pos).withColumn("session", F.floor(F.col("pos") / per_session) + 1).drop("key")


def events(spark: SparkSession, beats: DataFrame, cycles: int = 1) -> DataFrame:
    """Rule events of laid-out beats: ep, chain, session, ord, kind, rid, head, body, prio, delta, instances, tags, rank.

    Priority: 10,000 times the speaker's rank, 100 for each chain, and the script's step; facts have priority 1.
    """
    table = spark.createDataFrame(scripts.rows(cycles)[1], scripts.EVENTS)
    facts = beats.where("beat_no = 0").withColumns({"beat_no": F.lit(-1), "session": F.lit(0).cast("long"), "pos": F.lit(-1)})
    rows = beats.unionByName(facts).join(table, ["motif", "beat_no"])
    rid = F.concat(F.lit("m"), F.col("chain").cast("string"), F.lit("_"), "rid")
    prio = F.when(F.col("flat"), F.col("k")).otherwise(10_000 * F.col("rank") + 100 * (F.col("chain") + 1) + F.col("k"))
    return rows.select("ep", "chain", "session", F.struct("pos", "chain", "ev_no").alias("ord"), "kind", F.when(F.col("kind") == "SAY", F.col("rid")).otherwise(rid).alias("rid"), filled(F.col("head")).alias("head"), F.transform("body", filled).alias("body"), prio.cast("long").alias("prio"), F.col("delta").cast("long").alias("delta"), F.transform("instances", filled).alias("instances"), "tags", "rank")


STATE = "struct<head:string,body:array<string>,prio:bigint,retracted:array<string>>"


def fold(log: DataFrame, keys: list[str]) -> DataFrame:
    """State (keys, rid, head, body, prio, retracted) of each rule after its events, in the order of ord.

    ADD and CONFLICT set a rule anew; SUPERSEDE keeps what it leaves empty and lifts retractions; CONDITION sets the
    body; SUPPORT adds to the priority; RETRACT adds instances. Updates of a rule never added give no row.
    """
    none = F.array().cast("array<string>")
    made = lambda h, b, p, r: F.struct(h.alias("head"), b.alias("body"), p.alias("prio"), r.alias("retracted"))

    def step(s: Column, e: Column) -> Column:
        kind, bare = e["kind"], (e["head"] == "") & (F.size(e["body"]) == 0)
        new = made(F.when(e["head"] == "", s["head"]).otherwise(e["head"]), F.when(bare, s["body"]).otherwise(e["body"]), F.when(e["prio"] == 0, s["prio"]).otherwise(e["prio"]), none)
        out = F.when(kind.isin("ADD", "CONFLICT"), made(e["head"], e["body"], e["prio"], none)).when(s.isNull(), s).when(kind == "SUPERSEDE", new)
        out = out.when(kind == "CONDITION", made(s["head"], e["body"], s["prio"], s["retracted"])).when(kind == "SUPPORT", made(s["head"], s["body"], s["prio"] + e["delta"], s["retracted"]))
        return out.when(kind == "RETRACT", made(s["head"], s["body"], s["prio"], F.array_union(s["retracted"], e["instances"]))).otherwise(s)

    rules = log.where(~F.col("kind").isin("NOTE", "SAY")).groupBy(*keys, "rid").agg(F.sort_array(F.collect_list(F.struct("ord", "kind", "head", "body", "prio", "delta", "instances"))).alias("log"))
    return rules.select(*keys, "rid", F.aggregate("log", F.lit(None).cast(STATE), step).alias("s")).where("s IS NOT NULL").select(*keys, "rid", "s.*")


def labelled(spark: SparkSession, beats: DataFrame, log: DataFrame) -> DataFrame:
    """(ep, chain, beat_no, option, status) of every task's options, by solving its chain's rules as of the task.

    Chains share no entity and no context, so a task's own chain decides its options: the work grows with the tasks.
    """
    tasks = beats.select("ep", "chain", "beat_no", "pos", "side", "ents", "grp", F.explode("options").alias("o"))
    key = F.concat_ws("/", "ep", "chain", "beat_no")
    probe = beats.select(key.alias("key"), "ep", "chain", "pos", "side", "ents", "grp")
    seen = probe.select("key", "ep", "chain", "pos").join(log, ["ep", "chain"]).where(F.col("ord.pos") <= F.col("pos"))
    rules = fold(seen, ["key"])
    given = probe.where("side = 'above'").select("key", F.lit("pf0").alias("rid"), F.concat(F.lit("c1_m"), F.col("chain").cast("string")).alias("head"), F.array().cast("array<string>").alias("body"), F.lit(1).cast("long").alias("prio"), F.array().cast("array<string>").alias("retracted"))
    universe = probe.select("key", F.lit("option").alias("sort"), F.explode("ents").alias("const")).unionByName(probe.select("key", F.lit("group").alias("sort"), F.col("grp").alias("const")))
    signature = spark.createDataFrame([("allow", ["option"]), ("active", ["option"]), ("grp", ["option", "group"]), ("pair", ["option", "option"])], "pred string, sorts array<string>")
    closure, _ = solve.solve(solve.ground(rules.unionByName(given), universe, signature))
    options = tasks.select("ep", "chain", "beat_no", key.alias("key"), filled(F.col("o")).alias("option"))
    asked = options.withColumn("literal", F.concat(F.lit("allow("), "option", F.lit(")")))
    verdict = solve.violations(closure, asked.select("key", "literal"))
    held = closure.select("key", "literal", F.lit(True).alias("held"))
    out = asked.join(verdict, ["key", "literal"]).join(held, ["key", "literal"], "left")
    return out.select("ep", "chain", "beat_no", "option", F.when(F.col("violation"), "forbidden").when(F.col("held"), "licensed").otherwise("silent").alias("status"))


def turns(beats: DataFrame, log: DataFrame, templates: DataFrame, seed: int = 1) -> DataFrame:
    """(ep, session, phase, ord, kind, text): what is said before the session's tasks, then the tasks.

    templates: key, texts (array); a text's ``{e}`` is the literal or the options. Silent events say nothing.
    """
    said = log.where(~F.array_contains("tags", "silent") & (F.col("ord.pos") >= 0)).select("ep", "session", F.when(F.col("kind") == "SAY", 1).otherwise(0).alias("phase"), "ord", F.when(F.col("kind") == "SAY", F.col("rid")).otherwise(F.col("kind")).alias("key"), F.coalesce(F.nullif("head", F.lit("")), "rid").alias("e"))
    task = beats.select("ep", "session", F.lit(2).alias("phase"), F.struct("pos", "chain", F.lit(0).alias("ev_no")).alias("ord"), F.lit("TASK").alias("key"), F.array_join(F.transform("options", filled), ", ").alias("e"))
    rows = said.unionByName(task).join(templates, "key")
    chosen = F.get("texts", F.pmod(draw(seed, "ep", "ord"), F.size("texts")).cast("int"))
    return rows.select("ep", "session", "phase", "ord", F.element_at(F.array(F.lit("update"), F.lit("noise"), F.lit("probe")), F.col("phase") + 1).alias("kind"), F.replace(chosen, F.lit("{e}"), "e").alias("text"))


def pad_to_budget(said: DataFrame, pool: DataFrame, target_tokens: int, seed: int = 1) -> DataFrame:
    """(ep, session, place, text): pool lines added to every session until its share of the episode's lack is used up.

    The lack is target_tokens less the episode's tokens, four characters each, in equal shares; the line that
    crosses a share still belongs to it. pool: i (0, 1, ... without gaps), text (not empty). A session walks the pool from
    a start of its own, so lines repeat only when it is shorter than the session's padding.
    """
    size = pool.agg(F.count(F.lit(1)).alias("size"), F.min(F.length("text")).alias("shortest"))
    lack = said.groupBy("ep").agg(F.greatest(F.lit(target_tokens) - F.floor(F.sum(F.length("text") + 1) / 4), F.lit(0)).alias("need"), F.countDistinct("session").alias("n"))
    share = said.select("ep", "session").distinct().join(lack, "ep").withColumn("chars", F.floor(F.col("need") * 4 / F.col("n"))).where("chars > 0").join(size, F.lit(True))
    start = F.pmod(draw(seed, "ep", "session"), F.col("size"))
    walk = share.select("ep", "session", "chars", "size", start.alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("chars") / F.col("shortest")) - 1)).alias("place"))
    lines = walk.withColumn("i", F.pmod(F.col("start") + F.col("place"), F.col("size"))).join(pool, "i")
    before = F.sum(F.length("text")).over(W.partitionBy("ep", "session").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return lines.withColumn("before", F.coalesce(before, F.lit(0))).where("before < chars").select("ep", "session", "place", "text")


def motif_chains_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motif_chains(spark, spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("ep")))


def layout_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave_beats(spark, motif_chains_dealt(spark, sf_dir)).select("ep", "chain", "motif", "beat_no", "pos", "session")


def scenario_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, interleave_beats(spark, motif_chains_dealt(spark, sf_dir)))
    return log.select("ep", "chain", "session", "ord.pos", "ord.ev_no", "kind", "rid", "head", F.array_join("body", " & ").alias("body"), "prio", "delta")


def scenario_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = solve.held(interleave_beats(spark, motif_chains_dealt(spark, sf_dir)))
    return labelled(spark, beats, solve.held(events(spark, beats)))


def padded_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations padded with part names up to 2,000 tokens."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("ep"), F.floor(F.col("turn") / 2).alias("session"), F.coalesce("text", F.lit("")).alias("text"))
    pool = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") - 1).alias("i"), F.concat("p_name", F.lit(" of "), "p_brand").alias("text"))
    return pad_to_budget(said, pool, 2000)


QUERIES = {"motif_chains": motif_chains_dealt} | {f.__name__: f for f in (layout_sessions, scenario_events, scenario_labels, padded_sessions)}
