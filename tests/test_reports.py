"""The summary against plain counts over the graded tasks; parsing where the tables give no case."""

from __future__ import annotations

import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from normalog.functions import parsing as P
from normalog.operators import reports
from normalog.plans import library


def test_summary_is_a_plain_count(spark, tiny):
    run = lambda sql: library.run(spark, tiny, sql).collect()
    rows, got = run("SELECT * FROM graded_full"), run(reports.SUMMARY)[0]
    rate = lambda xs: round(sum(xs) / len(xs), 4) if xs else None
    exam = lambda xs: round(sum(r.weight * r.score for r in xs) / sum(r.weight for r in xs), 4) if xs else None
    want = {"n_probes": len(rows), "exam": exam(rows), "violation": rate([r.violation for r in rows]), "completion": rate([r.completed for r in rows]), "abstention": rate([r.abstained for r in rows])}
    for t in reports.TIERS:
        own = [r for r in rows if r.span_tier == t]
        want |= {f"exam_{t}": exam(own), f"violation_{t}": rate([r.violation for r in own]), f"n_{t}": len(own)}
    want |= {"violation_weighted": round(sum(r.weight * r.violation for r in rows) / sum(r.weight for r in rows), 4), "mean_read_calls": round(statistics.mean(r.n_reads for r in rows), 2)}
    traps, canary, bad = [r for r in rows if r.is_trap], [r for r in rows if r.tests == "CANARY"], [r for r in rows if r.violation]
    want |= {"violation_trap": rate([r.violation for r in traps]), "stale_trap_rate": rate([r.took_stale_trap for r in traps]), "canary_completion": rate([r.completed for r in canary]), "canary_false_violation": rate([r.violation for r in canary])}
    want["staleness_attribution"] = rate([r.stale_attributed for r in bad])
    by, lags = defaultdict(list), []
    for r in sorted(rows, key=lambda r: r.ord):
        by[r.ep, r.motif].append(r)
    for own in by.values():
        flips = [i for i, r in enumerate(own) if r.flip]
        if flips:
            lags.append(next((i - flips[0] for i in range(flips[0], len(own)) if not own[i].violation), None))
    want |= {"adaptation_lag_censored": lags.count(None)}
    known = [x for x in lags if x is not None]
    want["adaptation_lag_mean"] = round(statistics.mean(known), 3) if known else None
    episodes = {r.ep for r in run("SELECT DISTINCT ep FROM ev")}
    free = [all(not r.violation for r in rows if r.ep == e) for e in episodes]
    want |= {"n_episodes": len(episodes), "episode_violation_free": rate(free)}
    assert {k: got[k] for k in want} == want
    rollup = run("SELECT * FROM rollup")
    # an episode without tasks meets every condition on its tasks
    assert {r.ep for r in rollup} == episodes and all(r.all_completed and r.violation_free for r in rollup if r.n_probes == 0)


def test_no_views_are_left_or_replaced(spark, tiny):
    spark.range(3).createOrReplaceTempView("events")
    library.run(spark, tiny, reports.QUERIES["violation_by_tests"]).collect()
    assert spark.table("events").count() == 3 and [t.name for t in spark.catalog.listTables()] == ["events"]
    spark.catalog.dropTempView("events")


def test_parsing(spark):
    one = lambda f, *x: spark.createDataFrame([x], ", ".join(f"x{i} string" for i in range(len(x)))).select(f(*(F.col(f"x{i}") for i in range(len(x)))).alias("y")).first().y
    assert one(P.fenced_json, '```json\n{"a": 1}\n```') == '{"a": 1}' and one(P.fenced_json, "}{") is None
    assert one(lambda s: P.whole_objects(s, "memory list"), '{"memory list": [{"k": "a}]"}, {"k": {"b": 2}}, {"k": "cut') == ['{"k": "a}]"}', '{"k": {"b": 2}}']
    assert one(lambda s: P.whole_objects(s, "memory list"), '{"other": [{"k": 1}]}') == []
    assert one(P.unusable, "(No script available)") and not one(P.unusable, "(Note) go") and one(P.unusable, None)
    assert one(P.whole, "session 12") == 12 and one(P.whole, "x -3.9") == -3 and one(P.whole, None) is None
    assert one(lambda s: P.rendered(P.complement(P.literal(s))), "~ok(A, b)") == "ok(A,b)"
    assert one(lambda s: P.offered(F.split(s, ",")), "b,a,b,c,d,e,f,g") == ["b", "a", "c", "d", "e", "f"]
