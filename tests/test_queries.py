"""Every query with SQL against DuckDB on the smallest tables, and the entry point."""

from __future__ import annotations

import collections
import glob
import hashlib
import math
import os
import re

import pytest

from normalog.plans import catalogue


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(tiny):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{tiny}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_same_rows(spark, tiny, con, name):
    got = catalogue.queries()[name](spark, tiny)
    want = con.sql(catalogue.oracles()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    at = [want.columns.index(c) for c in cols]
    a = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=str)
    b = sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert a == b


def test_hash_embed_takes_the_whole_text(spark, tmp_path):
    text = {1: "It's a well-known rule: the COUNCIL met, and the council's x 42nd vote went on long after forty characters.", 2: "", 3: "a . !", 4: "one", 5: None, 6: "go go go-go"}
    spark.createDataFrame(list(text.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in text.items():
        words, v = re.findall(r"[a-z0-9][a-z0-9\-']+", (t or "").lower()), collections.Counter()
        for g in words + [f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)]:
            h = int(hashlib.md5(g.encode()).hexdigest(), 16)
            v[h % 512] += 1 if h >> 8 & 1 else -1
        norm_ = math.sqrt(sum(x * x for x in v.values())) or 1
        want |= {(i, b): round(x / norm_, 9) for b, x in v.items()}
    got = catalogue.queries()["hash_embed"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.bucket): round(r.weight, 9) for r in got} == want


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert row.n_probes > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
