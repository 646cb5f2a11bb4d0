"""Operator 6 (native), quality rules: host-level verdicts from document failures.

Each document's own measures decide ``base_failed`` and, rule by rule (``RULES``), what counts against its host (here:
source). A host's failure rate of a rule is shrunk by a beta prior fitted to all hosts' rates of that rule:
rate = (failures + a) / (documents + a + b). The prior's mean is the hosts' median rate and its deviation their
quartiles' distance / 1.349, so that bad hosts do not widen it; it weighs as much as 1 to 20 documents. A host goes if
for any rule the low end of its posterior (mean less two deviations) lies above the prior's upper tail (mean plus three
deviations) and above one half, that is if most of its documents surely fail and hosts in general do not. The verdict is
joined back, so all of a rejected host's documents go; those of other hosts answer for themselves alone.

Null texts have no words (and so fail). A null host is a host of its own. Repeated rows count each by itself.
Columns other than id, text and host are neither read nor touched. Empty tables give empty results.
The host count, not the document count, bounds what is grouped; partial sums come before the only shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normalog.llm.common import cut, table, words

SYMBOLS = "#*$%&|<>"
#: What fails, as SQL over the measures: too few words, mostly repeats, a symbol for ten words, 3 of 10 lines seen before.
RULES = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words", "symbols": "10 * n_symbols > n_words", "lines": "10 * n_dup_lines > 3 * n_lines"}
#: Hosts counted before they are broadcast; with more, the join shuffles.
BROADCAST_HOSTS = 20_000


def n_repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more: equal windows become neighbours by sorting (hash, place)."""
    keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    s = F.sort_array(keys)
    same = lambda s, j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
    hit = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, j, j - 1) | same(s, j, j + 1)), lambda x: x["i"]))
    covered = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["at"])).alias("n"), x.alias("at")))["n"]
    # transform over a one-element array names a value, so that it is computed once
    let = lambda value, f: F.transform(F.array(value), f)[0]
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(s, lambda s: let(hit(s), covered))).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one struct column _m: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, the rules, base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    let = lambda value, f: F.transform(F.array(value), f)[0]
    without = body
    for c in SYMBOLS:
        without = F.replace(without, F.lit(c), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    facts = let(
        words(body),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            n_repeat_words(w).alias("n_repeat_words"),
        ),
    )
    counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.withColumns({"_f": facts, "_l": counts, "_s": (F.octet_length(body) - F.octet_length(without)).cast("long")})
    m = F.struct("_f.n_words", "_f.word_chars", F.col("_s").alias("n_symbols"), "_l.n_dup_lines", "_f.n_repeat_words", "_l.n_lines")
    out = out.withColumn("_m", m).drop("_f", "_l", "_s")
    failed = {k: F.expr(re.sub(r"\bn_", "_m.n_", rule)) for k, rule in RULES.items()}
    return out.withColumn("_m", F.struct("_m.*", *(c.alias(k) for k, c in failed.items()), (failed["short"] | failed["repeats"]).alias("base_failed")))


def host_verdicts(measured: DataFrame, host: str = "source") -> DataFrame:
    """_host, host_docs, a shrunk rate for each rule, host_ok of every host. measured: the host column and the rules' booleans."""
    hosts = measured.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("host_docs"), *(F.sum(F.col(k).cast("long")).alias(k) for k in RULES))
    rates = {k: F.col(k) / F.col("host_docs") for k in RULES}
    p = hosts.agg(F.count(F.lit(1)).alias("n"), *(F.percentile(r, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(k) for k, r in rates.items())).first()
    ok, out = F.lit(True), [F.col("_host"), F.col("host_docs")]
    for k in RULES:
        low, m, high = p[k] or (0.0, 0.0, 0.0)
        v = ((high - low) / 1.349) ** 2
        weight = min(max(m * (1 - m) / v - 1, 1.0), 20.0) if v > 0 else 20.0
        rate = (F.col(k) + m * weight) / (F.col("host_docs") + weight)
        sure = rate - 2 * F.sqrt(rate * (1 - rate) / (F.col("host_docs") + weight + 1))
        ok = ok & (sure <= max(m + 3 * v**0.5, 0.5))
        out.append(rate.alias(f"rate_{k}"))
    out = hosts.select(*out, ok.alias("host_ok"))
    return F.broadcast(out) if p["n"] <= BROADCAST_HOSTS else out


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs, all columns as they were, that pass their own rules and their host's verdict."""
    m = measures(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), F.col(host).alias("_source")), "_text")
    hosts = host_verdicts(m.select("_source", *(F.col(f"_m.{k}").alias(k) for k in RULES)), "_source")
    good = m.where(~F.col("_m.base_failed")).join(hosts.where("host_ok"), F.col("_source").eqNullSafe(F.col("_host")), "left_semi")
    return good.select("_row.*")


def quality(docs: DataFrame, text: str = "text", id_col: str = "doc_id", host: str = "source") -> DataFrame:
    """The measures of every row, and kept."""
    m = cut(measures(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("_text"), F.col(host).alias("_source")), "_text").select("doc_id", "_source", "_m.*"))
    out = m.join(host_verdicts(m, "_source"), F.col("_source").eqNullSafe(F.col("_host")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"))


def op6_quality_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


#: DuckDB's form of the same result.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM d)),
k AS (SELECT r, i, w || ' ' || lead(w) OVER q || ' ' || lead(w, 2) OVER q AS g FROM w WINDOW q AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM k WHERE g IS NOT NULL) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + o.o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) o GROUP BY r),
wc AS (SELECT r, count(*) AS n, sum(length(w)) AS c FROM w GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
dl AS (SELECT r, count(*) AS lines, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, source, coalesce(wc.n, 0) AS n_words, coalesce(wc.c, 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(dl.lines, 0) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN wc USING (r) LEFT JOIN dl USING (r) LEFT JOIN cov USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
f AS (SELECT doc_id, source, unnest([1, 2, 3, 4]) AS rule, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines]) AS failed FROM m),
h AS (SELECT source, rule, count(*) AS n, sum(failed::INT) AS f FROM f GROUP BY source, rule),
p0 AS (SELECT rule, quantile_cont(f / n, 0.5) AS m, (quantile_cont(f / n, 0.75) - quantile_cont(f / n, 0.25)) / 1.349 AS sd FROM h GROUP BY rule),
p AS (SELECT rule, m, greatest(m + 3 * sd, 0.5) AS most, CASE WHEN sd > 0 THEN least(greatest(m * (1 - m) / (sd * sd) - 1, 1.0), 20.0) ELSE 20.0 END AS wt FROM p0),
s AS (SELECT source, most, n + wt + 1 AS weight, (f + m * wt) / (n + wt) AS rate FROM h JOIN p USING (rule)),
ok AS (SELECT source, bool_and(rate - 2 * sqrt(rate * (1 - rate) / weight) <= most) AS good FROM s GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND good) AS kept
FROM b JOIN ok ON b.source IS NOT DISTINCT FROM ok.source
"""
