"""Order-dependent operators against plain loops."""

from __future__ import annotations

from normalog.operators import sequential


def turns_of(spark, tiny):
    out: dict = {}
    for r in spark.read.parquet(f"{tiny}/conversations.parquet").orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, []).append((r.turn, len(r.text)))
    return out


def test_keep_skipping(spark, tiny):
    got = {(r.conv_id, r.turn): r.kept for r in sequential.greedy_keep_noncontiguous(spark, tiny).collect()}
    for c, turns in turns_of(spark, tiny).items():
        used = 0
        for t, n in reversed(turns):
            fits = used + n <= 1500
            used += n * fits
            assert got[c, t] == fits


def test_flush(spark, tiny):
    got = {(r.conv_id, r.turn): r.flush for r in sequential.buffered_flush(spark, tiny).collect()}
    for c, turns in turns_of(spark, tiny).items():
        held = flush = 0
        for t, n in turns:
            if held and held + n > 1000:
                held, flush = 0, flush + 1
            held += n
            assert got[c, t] == flush
            if held >= 1000:
                held, flush = 0, flush + 1


def test_greedy(spark, tiny):
    rows = sequential.select_probes_greedy(spark, tiny).collect()
    assert rows and all(r.place < 6 for r in rows)
    assert len({(r.ep, r.sess) for r in rows}) == len(rows)
