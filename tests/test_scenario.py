"""Generated scenarios: labels of every motif, order, sessions, padding, reruns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from normalog.operators import scenario, scripts, solve

#: for each task of a motif, what stands of its options: + licensed, - forbidden, ? silent
EXPECTED = {
    "conflict_flip": "x+y+ x-y+ x+y-",
    "supersede_alt": "x+y+ x-y+",
    "conditionalize": "x+y+ x-y+ x+y- x-z+",
    "retract_partial": "w+x+ w+x- w-x+",
    "conflict_chain": "x+y+ x-y+ x+y-",
    "support_threshold": "x+y+ x-y+",
    "condition_widen": "x+z+ x-z+",
    "canary": "x+y?",
    "ctx_flipflop": "x+y+ x-y+ x+y- x+y-z+ x-y-z+ x+y-z+ x-y-z+",
    "alias": "x+y+z+ x+y+z+ x-y-z+ x+y+z+ x+y-z+",
    "group_dynamics": "w+x+z+ w+x-z+ w+x-z- w+x+z+ w+x-z- w+x+z-",
    "hierarchy": "x+y+ x-y+ x-y+ x+y+ x-y+z+",
    "stale_reminder": "x+y+ x-y+ x-y+ x+y-",
    "reinstate_arc": "x+y+ x-y+ x+y+ x-y+ x+y- x-y-z+",
    "proposal_noise": "x+y+ x+y+ x+y- x+y-",
    "threshold": "x+y+ x-y+ x+y+ x-y+ x+y+ x-y-",
    "derived": "x+y+z+ x+y+z+ x-y+z+ x+y+z- x-y+z-",
    "conjunctive": "x+y+ x+y+ x-y+z+ x-y-z+ x+y-z+ x-y-z+ x+y-z+ x-y-z+",
}


@pytest.fixture(scope="module")
def laid(spark):
    chains = spark.createDataFrame([(1, i, m, [f"e{4 * i + j + 1:02d}" for j in range(4)], f"g{i % 6 + 1}") for i, m in enumerate(EXPECTED)], "ep long, chain int, motif string, ents array<string>, grp string")
    beats = solve.held(scenario.interleave_beats(spark, chains))
    return beats, solve.held(scenario.events(spark, beats))


def test_labels(spark, laid):
    beats, log = laid
    rows = scenario.labelled(spark, beats, log).join(beats.select("ep", "chain", "beat_no", "motif", "ents"), ["ep", "chain", "beat_no"]).collect()
    mark, got = {"forbidden": "-", "licensed": "+", "silent": "?"}, {}
    for r in rows:
        got.setdefault(r.motif, {}).setdefault(r.beat_no, []).append("xyzw"[r.ents.index(r.option)] + mark[r.status])
    assert {m: " ".join("".join(sorted(v)) for _, v in sorted(b.items())) for m, b in got.items()} == EXPECTED


def test_order_and_sessions(laid):
    beats, _ = laid
    rows = beats.orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(rows)))
    seen: dict = {}
    for r in rows:
        assert r.beat_no == seen.get(r.chain, -1) + 1 and r.session == r.pos // 2 + 1
        seen[r.chain] = r.beat_no


def test_cycles_repeat_blocks():
    one, three = (len([r for r in scripts.rows(c)[0] if r[0] == "hierarchy"]) for c in (1, 3))
    assert (one, three) == (5, 11)
    rids = [e[4] for e in scripts.rows(2)[1] if e[0] == "hierarchy" and e[3] == "ADD"]
    assert "low0_x" in rids and "low1_x" in rids


def test_chains(spark):
    eps = spark.range(20).withColumnRenamed("id", "ep")
    chains = scenario.motif_chains(spark, eps, 24)
    ents = chains.select("ep", F.explode("ents").alias("x")).groupBy("ep").agg(F.countDistinct("x").alias("n"), F.min("x"), F.max("x"))
    assert {tuple(r)[1:] for r in ents.collect()} == {(96, "e01", "e96")}
    again = scenario.motif_chains(spark, eps.repartition(3), 24)
    assert chains.exceptAll(again).isEmpty()
    with pytest.raises(ValueError):
        scenario.motif_chains(spark, eps, 25)


def test_turns_and_padding(spark, laid):
    beats, log = laid
    keys = ["ADD", "SUPERSEDE", "CONDITION", "CONFLICT", "SUPPORT", "RETRACT", "NOTE", "TASK", "stale_echo", "praise", "hearsay", "proposal", "question", "other_team", "rescind"]
    templates = spark.createDataFrame([(k, [f"{k} of {{e}}", f"{{e}} has {k}"]) for k in keys], "key string, texts array<string>")
    said = solve.held(scenario.turns(beats, log, templates))
    assert said.where("kind = 'probe'").count() == beats.count()
    silent = log.where(F.array_contains("tags", "silent")).count()
    assert silent and said.where("kind = 'update'").count() == log.where("kind <> 'SAY' AND ord.pos >= 0").count() - silent
    pool = spark.createDataFrame([(i, f"pad line {i} " + "z" * (i % 17)) for i in range(300)], "i long, text string")
    pad = scenario.pad_to_budget(said, pool, 6000)
    base = sum(len(r.text) + 1 for r in said.collect()) // 4
    share = (6000 - base) * 4 // said.select("session").distinct().count()
    got: dict = {}
    for r in pad.orderBy("session", "place").collect():
        got.setdefault(r.session, []).append(r.text)
    assert len(got) == said.select("session").distinct().count()
    for lines in got.values():
        assert sum(map(len, lines)) >= share > sum(map(len, lines[:-1]))
    assert scenario.pad_to_budget(said, pool, 10).isEmpty()


def test_fold_keeps_what_an_update_leaves_out(spark):
    log = [(1, 1, "ADD", "allow(x)", ["c"], 5, 0, []), (1, 2, "RETRACT", "", [], 1, 0, ["x"]), (1, 3, "SUPERSEDE", "", [], 0, 0, []), (1, 4, "SUPPORT", "", [], 1, 3, []), (2, 1, "SUPPORT", "", [], 1, 3, []), (3, 1, "CONFLICT", "a", [], 2, 0, []), (3, 2, "CONDITION", "", ["k"], 9, 0, [])]
    df = spark.createDataFrame([(1, f"r{r}", *x) for r, *x in log], "key int, rid string, ord int, kind string, head string, body array<string>, prio long, delta long, instances array<string>")
    got = {r.rid: (r.head, r.body, r.prio, r.retracted) for r in scenario.fold(df, ["key"]).collect()}
    assert got == {"r1": ("allow(x)", ["c"], 8, []), "r3": ("a", ["k"], 2, [])}
