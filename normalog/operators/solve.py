"""Derivation with bodies and variables: grounding, closed-form defeat, forward chaining and the outer fixpoint.

All episodes and epochs are solved at once: relations carry a key, and each round is a few joins on (key, literal). A
round's result is written to the checkpoint folder, so plans stay short and lost executors cost one round.

Relations: rules (key, rid, pred, args, neg, body, prio), with body an array of literal texts; universe (key, sort,
const); signature (pred, sorts). A literal's text is ``[~]pred[(a,b)]``; arguments that start with ``?`` are variables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from normalog.sources import scratch

MAX_ROUNDS = 32


def atom(literal: Column) -> Column:
    return F.regexp_replace(literal, r"^~|\s+", "")


def negative(literal: Column) -> Column:
    return F.startswith(F.ltrim(literal), F.lit("~"))


def render(neg: Column, text: Column) -> Column:
    return F.concat(F.when(neg, "~").otherwise(""), text)


def complement(literal: Column) -> Column:
    return render(~negative(literal), atom(literal))


def held(df: DataFrame) -> DataFrame:
    """df computed once, reliably, in the session's checkpoint folder."""
    scratch.shared(df.sparkSession)
    return df.checkpoint()


def ground(rules: DataFrame, universe: DataFrame, signature: DataFrame) -> DataFrame:
    """Nodes (key, rid, nid, head, body, prio): every rule under every assignment of its variables' sorts.

    rules: key, rid, head, body, prio, and optionally retracted (array of argument texts whose nodes are dropped).
    A rule without variables has one node; a variable of an empty sort, none. Variables are bound one at a time, by an
    equi-join on (key, sort), so the plan holds no cross product of unrelated keys.
    """
    literal = F.explode(F.concat(F.array("head"), "body"))
    args = F.filter(F.split(F.regexp_extract(F.col("l"), r"\((.*)\)", 1), r"\s*,\s*"), lambda a: a != "")
    named = rules.select("key", "rid", literal.alias("l")).select("key", "rid", F.regexp_extract(atom(F.col("l")), r"^[^(]*", 0).alias("pred"), F.posexplode(args).alias("i", "arg"))
    sorts = named.where(F.startswith("arg", F.lit("?"))).join(signature.select("pred", F.posexplode("sorts").alias("i", "sort")), ["pred", "i"])
    variables = sorts.groupBy("key", "rid", "arg").agg(F.min("sort").alias("sort"), F.countDistinct("sort").alias("kinds"))
    variables = variables.withColumn("sort", F.when(F.col("kinds") > 1, F.raise_error(F.lit("one variable at two sorts"))).otherwise(F.col("sort")))
    listed = variables.groupBy("key", "rid").agg(F.sort_array(F.collect_list(F.struct(F.col("arg").alias("var"), "sort"))).alias("vars"))
    nodes = held(rules.join(listed, ["key", "rid"], "left").withColumn("vars", F.coalesce("vars", F.array().cast("array<struct<var:string,sort:string>>"))).withColumn("theta", F.lit("")))
    put = lambda text: F.regexp_replace(text, F.concat(F.lit(r"\Q"), F.col("v.var"), F.lit(r"\E(?=[,)\s])")), F.col("const"))
    done = nodes.where(F.size("vars") == 0)
    rest = nodes.where(F.size("vars") > 0)
    while not rest.isEmpty():
        bound = rest.withColumn("v", F.get("vars", F.lit(0))).withColumn("vars", F.slice("vars", 2, 1000))
        bound = bound.join(universe.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("v.sort") == F.col("sort")))
        bound = bound.withColumns({"head": put(F.col("head")), "theta": F.concat("theta", F.when(F.col("theta") != "", ",").otherwise(""), "v.var", F.lit("="), "const")})
        bound = held(bound.withColumn("body", F.transform("body", lambda b: put(b))).select(*nodes.columns))
        done, rest = done.unionByName(bound.where(F.size("vars") == 0)), bound.where(F.size("vars") > 0)
    if "retracted" in rules.columns:
        done = done.where(~F.coalesce(F.array_contains("retracted", F.regexp_extract(F.regexp_replace("head", r"\s+", ""), r"\((.*)\)", 1)), F.lit(False)))
    return done.select("key", "rid", F.concat("rid", F.lit("#"), "theta").alias("nid"), render(negative(F.col("head")), atom(F.col("head"))).alias("head"), F.transform("body", lambda b: render(negative(b), atom(b))).alias("body"), "prio")


def grounded(nodes: DataFrame) -> DataFrame:
    """nodes with in: undefeated. The side with the higher top is in as a whole; on a tie, both top classes are."""
    w = W.partitionBy("key", atom(F.col("head")))
    neg = negative(F.col("head"))
    top = lambda side: F.coalesce(F.max(F.when(neg == F.lit(side), F.col("prio"))).over(w), F.lit(-(2**62)))
    own, other = F.when(neg, top(True)).otherwise(top(False)), F.when(neg, top(False)).otherwise(top(True))
    return nodes.withColumn("in", (own > other) | (own == other) & (F.col("prio") == own))


def satisfied(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Nodes all of whose body literals stand in facts (key, literal): relational division by counts."""
    need = nodes.where(F.size("body") > 0).select("key", "nid", F.explode(F.array_distinct("body")).alias("literal"))
    met = need.join(facts, ["key", "literal"]).groupBy("key", "nid").agg(F.count(F.lit(1)).alias("met"))
    full = nodes.join(met, ["key", "nid"], "left").where(F.coalesce("met", F.lit(0)) == F.size(F.array_distinct("body")))
    return full.drop("met")


def forward_chain(nodes: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Least fixpoint (key, literal) of the nodes' heads from the seed; only new literals can fire more nodes."""
    facts = held((seed if seed is not None else nodes.select("key", F.col("head").alias("literal")).limit(0)).distinct())
    while True:
        new = held(satisfied(nodes, facts).select("key", F.col("head").alias("literal")).distinct().join(facts, ["key", "literal"], "left_anti"))
        if new.isEmpty():
            return facts
        facts = held(facts.unionByName(new))


def solve(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closure (key, literal), keys (key, converged, rounds)) of all keys.

    Round by round: nodes whose bodies stand in the closure are decided by defeat; the undefeated and those not yet
    applicable are chained; a key is done when its closure repeats itself, and has not converged if it repeats an earlier
    one. The first round applies bodiless nodes alone and chains all others, as does the definition it follows.
    """
    nodes = held(nodes)
    open_ = held(nodes.select("key").distinct())
    closure = held(nodes.select("key", F.col("head").alias("literal")).limit(0))
    seen = held(open_.select("key", F.lit("").alias("state"), F.lit(0).alias("round")))
    done_facts, done_keys = None, None
    join = lambda a, b: b if a is None else a.unionByName(b)
    for r in range(1, MAX_ROUNDS + 1):
        mine = nodes.join(open_, "key", "left_semi")
        fits = satisfied(mine, closure)
        kept = grounded(fits).where("in").drop("in")
        later = mine.join(fits.select("key", "nid"), ["key", "nid"], "left_anti")
        now = forward_chain(held(kept.unionByName(later)))
        state = open_.join(now.groupBy("key").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("literal")), "\n"), 256).alias("state")), "key", "left").select("key", F.coalesce("state", F.lit("")).alias("state"))
        before = seen.groupBy("key", "state").agg(F.max("round").alias("was"))
        verdict = held(state.join(before, ["key", "state"], "left").select("key", "state", (F.col("was") == r - 1).alias("converged")))
        end = verdict.where("converged IS NOT NULL")
        done_facts = join(done_facts, now.join(end, "key", "left_semi"))
        done_keys = join(done_keys, end.select("key", "converged", F.lit(r).alias("rounds")))
        open_ = held(verdict.where("converged IS NULL").select("key"))
        closure = now.join(open_, "key", "left_semi")
        if open_.isEmpty():
            break
        seen = held(seen.unionByName(verdict.select("key", "state", F.lit(r).alias("round"))))
    else:
        done_facts, done_keys = join(done_facts, closure), join(done_keys, open_.select("key", F.lit(False).alias("converged"), F.lit(MAX_ROUNDS).alias("rounds")))
    return done_facts, done_keys


def contradictions(closure: DataFrame) -> DataFrame:
    """Positive literals whose complement is derived too."""
    other = closure.where(negative(F.col("literal"))).select("key", complement(F.col("literal")).alias("literal"))
    return closure.where(~negative(F.col("literal"))).join(other, ["key", "literal"], "left_semi")


def violations(closure: DataFrame, asserted: DataFrame) -> DataFrame:
    """asserted (key, literal) with violation: its complement is derived, or the key's closure contradicts itself."""
    against = closure.select("key", complement(F.col("literal")).alias("literal"), F.lit(True).alias("hit"))
    broken = contradictions(closure).select("key").distinct().withColumn("broken", F.lit(True))
    out = asserted.join(against, ["key", "literal"], "left").join(broken, "key", "left")
    return out.select("key", "literal", F.coalesce("hit", "broken", F.lit(False)).alias("violation"))
