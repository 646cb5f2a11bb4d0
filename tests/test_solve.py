"""Golden closures, and random rule sets of many keys at once against a naive evaluator."""

from __future__ import annotations

import random

from normalog.operators import solve

RULES = "key long, rid string, head string, body array<string>, prio long"


def no(lit):
    return lit[1:] if lit.startswith("~") else "~" + lit


def naive(nodes):
    """nodes: (head, body, prio) to (closure, converged): defeat decided by iterated deletion."""
    closure, history = set(), [set()]
    for _ in range(32):
        fits = [n for n in nodes if set(n[1]) <= closure]
        status = {}
        while len(status) < len(fits):
            for i, (h, _, p) in enumerate(fits):
                if i not in status:
                    foes = [j for j, (g, _, q) in enumerate(fits) if g == no(h) and q > p]
                    if all(status.get(j) is False for j in foes):
                        status[i] = True
                    elif any(status.get(j) for j in foes):
                        status[i] = False
        pool = [n for i, n in enumerate(fits) if status[i]] + [n for n in nodes if not set(n[1]) <= closure]
        new, grown = set(), True
        while grown:
            fresh = {h for h, b, _ in pool if set(b) <= new} - new
            new |= fresh
            grown = bool(fresh)
        if new == closure:
            return new, True
        if new in history:
            return new, False
        history.append(new)
        closure = new
    return closure, False


def closed(spark, rules, consts=("A", "B"), **more):
    r = spark.createDataFrame([(1, *x) for x in rules], RULES)
    u = spark.createDataFrame([(1, "e", c) for c in consts] + [(1, "g", "gx")], "key long, sort string, const string")
    s = spark.createDataFrame([("ok", ["e"]), ("callable", ["e"]), ("grp", ["e", "g"])], "pred string, sorts array<string>")
    closure, keys = solve.solve(solve.ground(r, u, s))
    assert keys.first().converged
    return {x.literal for x in closure.collect()}, closure


def test_conflict_by_priority(spark):
    rules = [("f1", "low_budget", [], 5), ("r1", "ok(A)", [], 1), ("r2", "~ok(A)", ["low_budget"], 2)]
    got, closure = closed(spark, rules)
    assert got == {"low_budget", "~ok(A)"}
    asked = spark.createDataFrame([(1, "ok(A)"), (1, "ok(B)")], "key long, literal string")
    assert {r.literal: r.violation for r in solve.violations(closure, asked).collect()} == {"ok(A)": True, "ok(B)": False}
    rules[1] = ("r1", "ok(A)", [], 3)
    assert closed(spark, rules)[0] == {"low_budget", "ok(A)"}


def test_variables_and_groups(spark):
    rules = [("f", "grp(A, gx)", [], 1), ("rA", "ok(A)", [], 1), ("rB", "ok(B)", [], 1), ("rg", "~ok(?X)", ["grp(?X,gx)"], 3)]
    assert closed(spark, rules)[0] == {"grp(A,gx)", "ok(B)", "~ok(A)"}
    assert closed(spark, [("r1", "callable(A)", [], 1), ("r3", "deploy_ok", ["callable(?E)"], 1)])[0] == {"callable(A)", "deploy_ok"}


def test_tie_contradicts_everything(spark):
    _, closure = closed(spark, [("a", "ok(A)", [], 2), ("b", "~ok(A)", [], 2)])
    assert [r.literal for r in solve.contradictions(closure).collect()] == ["ok(A)"]
    asked = spark.createDataFrame([(1, "ok(B)")], "key long, literal string")
    assert solve.violations(closure, asked).first().violation


def test_random_rule_sets(spark):
    rnd = random.Random(8)
    rows, want = [], {}
    for key in range(60):
        lits = [s + a for a in "pqrst" for s in ("", "~")]
        nodes = [(rnd.choice(lits), rnd.sample(lits, rnd.choice([0, 0, 1, 2])), rnd.randint(1, 4)) for _ in range(rnd.randint(2, 9))]
        rows += [(key, f"r{i}", f"r{i}#", h, b, p) for i, (h, b, p) in enumerate(nodes)]
        want[key] = naive(nodes)
    # a rule that defeats what it needs never settles
    osc = [("p", [], 1), ("~p", ["p"], 2)]
    rows += [(100, f"r{i}", f"r{i}#", *n) for i, n in enumerate(osc)]
    want[100] = naive(osc)
    nodes = spark.createDataFrame(rows, "key long, rid string, nid string, head string, body array<string>, prio long")
    closure, keys = solve.solve(nodes)
    got = {k: set() for k in want}
    for r in closure.collect():
        got[r.key].add(r.literal)
    flags = {r.key: r.converged for r in keys.collect()}
    assert {k: (got[k], flags[k]) for k in want} == want
    assert not flags[100]
