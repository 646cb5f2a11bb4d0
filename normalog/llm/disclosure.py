"""Operator 7 (native), personal data: patterns, and terms that disclose protected entities.

Protected entities are what the four patterns find: e-mail and IP addresses, card and phone numbers. Other words of a
document may reveal one of its entities although the entity itself is masked. Over the corpus, the information that a
term gives about an entity is their pointwise mutual information, PMI = log2(P(entity | term) / P(entity)), with the
rows whose texts hold the term (outside of entities) and the entity; the entity's own information is IC = -log2 P(entity).
A term discloses an entity if both stand in ``support`` different texts or more, P(entity | term) reaches ``share`` and
PMI reaches ``part`` of IC: relative to IC, rare and frequent entities alike can be disclosed. Wherever a disclosing term
stands in a text that holds its entity it is a span too; ``sanitise`` generalises entities to their kind and removes such
terms. Texts without entities are never touched.

Terms are words in lower case without punctuation around them. Pairs are made only of terms rare enough to reach
``share``, which common words are not, after counting each term over all texts. What is between or inside of a text is
worked out by sorted places and chunked scans, so its cost grows with its length.

Null texts are empty. Equal (id, text) rows get equal results. An empty table gives no rows. Other columns of docs
are not read by ``find`` and stay as they are, whatever their names, in ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from normalog.llm.common import cut, table, words

#: The contract's patterns. Possessive loops and the look-behinds only keep long runs linear:
#: a start inside a run of the same characters could match no more than the run's first one.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Items that a scan appends to one array, and not to one of arrays.
CHUNK = 256
#: Stands for an entity's characters; a word that holds one is part of an entity and no term.
FILL = "\ue000"
SPAN = "array<struct<kind:string,s:int,e:int,v:string>>"


def let(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second one doubles."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda x: x - F.when(x > 9, 9).otherwise(0)))
    return F.aggregate(F.filter(d, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda x: (F.length(x) > 3) | (F.coalesce(F.when(F.length(x) <= 3, F.when(x == "", 0).otherwise(x.cast("int"))), F.lit(0)) > 255)))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def scan(items: Column, zero: Column, kind: str, step) -> Column:
    """What step(state, item) = (next state, output of that kind) puts out for each item. Chunked, so that no long array is copied for each."""

    def through(state, chunk):
        def one(a, x):
            state, out = step(a["state"], x)
            return F.struct(state.alias("state"), F.concat(a["out"], F.array(out)).alias("out"))

        return F.aggregate(chunk, F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), one)

    def outer(a, chunk):
        return let(through(a["state"], chunk), lambda r: F.struct(r["state"].alias("state"), F.concat(a["outs"], F.array(r["out"])).alias("outs")))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))
    every = F.aggregate(chunks, F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs")), outer)["outs"]
    return F.when(F.size(items) > 0, F.flatten(every)).otherwise(F.array().cast(f"array<{kind}>"))


def matches(text: Column, kind: str, pattern: str, cheap: Column) -> Column:
    """Spans of the kind: what lies between matches (split) and the matches themselves give every start."""

    def walk(gaps: Column, found: Column) -> Column:
        sized = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("n")))
        starts = scan(sized, F.lit(0), "int", lambda at, x: (at + x["g"] + x["n"], at + x["g"]))
        spans = F.zip_with(starts, found, lambda s, m: F.struct(F.lit(kind).alias("kind"), s.alias("s"), (s + F.char_length(m)).alias("e"), m.alias("v")))
        return F.filter(spans, lambda x: passes(kind, x["v"]))

    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    some = let(every, lambda found: F.when(F.exists(found, lambda m: passes(kind, m)), walk(F.split(text, pattern, -1), found)).otherwise(F.array().cast(SPAN)))
    return F.when(cheap, some).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    two = text.rlike(r"[0-9][\x20-]?[0-9]")
    return {
        "email": matches(text, "email", EMAIL, F.contains(text, F.lit("@"))),
        "ip": matches(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]")),
        "card": matches(text, "card", CARD, two),
        "phone": matches(text, "phone", PHONE, text.rlike(r"\+[0-9]")),
    }


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def rewritten(text: Column, marks: Column) -> Column:
    """text with each marked place replaced. marks: (s, e, to), by s; of overlapping ones the later only extends what goes."""
    kept = "struct<at:int,s:int,to:string,first:boolean>"
    step = lambda at, m: (F.greatest(at, m["e"]), F.struct(at.alias("at"), m["s"].alias("s"), m["to"].alias("to"), (m["s"] >= at).alias("first")))
    pieces = F.transform(F.filter(scan(marks, F.lit(0), kept, step), lambda x: x["first"]), lambda x: F.concat(F.substring(text, x["at"] + 1, x["s"] - x["at"]), x["to"]))
    end = F.coalesce(F.array_max(F.transform(marks, lambda m: m["e"])), F.lit(0))
    return F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.char_length(text)))


def masked(text: Column, spans: Column) -> Column:
    """text with FILL for each character of the spans, so that all other words keep their places."""
    return rewritten(text, F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.repeat(F.lit(FILL), x["e"] - x["s"]).alias("to")))))


def bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^\p{Punct}+|\p{Punct}+$", ""))


def entity_of(x: Column) -> Column:
    return F.concat_ws(":", x["kind"], F.lower(x["v"]))


def corpus_terms(docs: DataFrame, text: str) -> DataFrame:
    """(term, rows): in how many rows' texts a term stands. Terms of a row are made distinct before any shuffle."""
    trim = lambda w: F.lower(F.btrim(w, F.lit("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")))
    return docs.select(F.explode(F.array_distinct(F.transform(F.array_distinct(words(F.col(text))), trim))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("rows"))


def disclosing(found: DataFrame, texts: DataFrame, support: int, share: float, part: float) -> DataFrame:
    """(entity, term) pairs over the thresholds. found: key, base of every row; texts: t of every row."""
    held = found.where(F.size("base") > 0).select("key", "m", F.explode(F.array_distinct(F.transform("base", entity_of))).alias("entity"))
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("holding"), F.countDistinct("key").alias("texts")).where(F.col("texts") >= support).select("entity", "holding")
    held = cut(held.groupBy("key", "m", "entity").agg(F.count(F.lit(1)).alias("copies")).join(entities, "entity"))
    total = found.count()
    if held.isEmpty():
        return held.select("entity", F.lit("").alias("term"))
    # the most that an entity of the text is held by bounds the terms that can disclose any of them
    hosts = held.groupBy("key", "m").agg(F.count(F.lit(1)).alias("times"), F.max("holding").alias("most"))
    terms = hosts.select("key", "most", F.explode(F.array_distinct(F.transform(words(F.col("m")), bare))).alias("term")).where((F.col("term") != "") & ~F.contains("term", F.lit(FILL)))
    near = terms.select("term").distinct()
    seen = corpus_terms(texts, "t").join(near, "term", "left_semi").where(F.col("rows") >= support)
    rare = terms.join(seen, "term").where(share * F.col("rows") <= F.col("most")).select("key", "term", "rows")
    pairs = held.select("key", "entity", "holding", "copies").join(rare, "key").where(share * F.col("rows") <= F.col("holding"))
    both = pairs.groupBy("entity", "term", "holding", "rows").agg(F.sum("copies").alias("both"), F.count(F.lit(1)).alias("texts"))
    p = F.col("both") / F.greatest("both", "rows")
    ic, pmi = -F.log2(F.col("holding") / total), F.log2(p * total / F.col("holding"))
    return cut(both.where((F.col("texts") >= support) & (p >= share) & (pmi > 0) & (pmi >= part * ic)).select("entity", "term"))


def term_spans(found: DataFrame, risky: DataFrame) -> DataFrame:
    """(key, terms): where the disclosing terms of a text's entities stand in it, ascending. found: key, m, base of every row."""
    held = found.where(F.size("base") > 0).select("key", "m", F.explode(F.array_distinct(F.transform("base", entity_of))).alias("entity"))
    wanted = cut(held.join(risky, "entity").select("key", "m", "term").distinct())
    parts = wanted.select("key", "m").distinct().select("key", F.posexplode(F.regexp_extract_all("m", F.lit(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), F.lit(0))).alias("i", "w"))
    upto = W.partitionBy("key").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    placed = parts.withColumn("at", F.coalesce(F.sum(F.char_length("w")).over(upto), F.lit(0)).cast("int")).withColumn("term", bare(F.col("w")))
    skip = F.char_length("w") - F.char_length(F.regexp_replace("w", r"^\p{Punct}+", ""))
    spans = placed.join(wanted.select("key", "term"), ["key", "term"], "left_semi").select("key", (F.col("at") + skip).alias("s"), (F.col("at") + skip + F.char_length("term")).alias("e"))
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("terms"))


def find(docs: DataFrame, text: str = "text", id_col: str = "doc_id", support: int = 2, share: float = 0.8, part: float = 0.9) -> DataFrame:
    """doc_id, key (the text's hash), the four counts, base_sha256, base (spans) and terms (spans) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    b = rows.select("doc_id", "t", F.xxhash64("t", F.length("t")).alias("key"), F.struct(*(c.alias(k) for k, c in base_spans(F.col("t")).items())).alias("b"))
    b = b.withColumn("base", F.concat(*(F.col(f"b.{k}") for k in KINDS)))
    b = cut(b.select("doc_id", "key", *(F.size(f"b.{k}").cast("long").alias(f"n_{k}") for k in KINDS), "base", F.when(F.size("base") > 0, masked(F.col("t"), F.col("base"))).alias("m")))
    b = b.withColumn("base_sha256", F.sha2(written(F.col("base")).cast("binary"), 256))
    terms = term_spans(b, disclosing(b, rows, support, share, part))
    return b.drop("m").join(terms, "key", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<s:int,e:int>>")))


def sanitise(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **thresholds) -> DataFrame:
    """docs with every found entity replaced by ``[KIND]`` and every disclosing term removed; all columns stay."""
    found = find(docs, text, id_col, **thresholds)
    marks = F.sort_array(F.concat(F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("to"))), F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("to")))))
    marked = found.where("size(base) > 0").select("key", marks.alias("marks")).dropDuplicates(["key"])
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("t"), F.xxhash64(body, F.length(body)).alias("key")).join(marked, "key", "left")
    changed = F.when(F.col("marks").isNull(), F.col("t")).otherwise(rewritten(F.col("t"), F.col("marks")))
    return rows.select(*(changed.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    terms = F.transform("terms", lambda x: F.struct(F.lit("term").alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", written(F.concat(base, terms)).alias("spans"))
