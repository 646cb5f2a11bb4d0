"""A domain corpus as flat rows, and its validation as joins of those rows with the rules.

``leaves`` takes JSON files to rows (corpus, path, key, idx, kind, text): the dotted path of what holds a value, its
name, its place in a list (-1 outside one), its JSON type and its text. A list or object has a row too, whose text
is its size. ``failures`` gives (corpus, place, problem), with no rows for a sound corpus.
"""

from __future__ import annotations

import json
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAVES = "corpus string, path string, key string, idx int, kind string, text string, slots array<string>, broken boolean"
KINDS = {str: "string", bool: "boolean", int: "int", float: "float", type(None): "null", list: "list", dict: "object"}


def slots_of(text: str) -> tuple[list[str], bool]:
    """Names in braces, and whether the text is no valid format string."""
    try:
        return sorted({f for _, f, _, _ in string.Formatter().parse(text) if f is not None}), False
    except ValueError:
        return [], True


def flat(value, path: str, key: str, idx: int = -1) -> Iterator[tuple]:
    kind = KINDS[type(value)]
    if kind in ("list", "object"):
        yield path, key, idx, kind, str(len(value)), [], False
        below = f"{path}.{key}" if path else key
        items = ((path, key, i, v) for i, v in enumerate(value)) if kind == "list" else ((below, k, idx, v) for k, v in value.items())
        for p, k, i, v in items:
            yield from flat(v, p, k, i)
    else:
        yield path, key, idx, kind, "" if value is None else str(value), *(slots_of(value) if kind == "string" else ([], False))


def leaves(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf.itertuples():
                rows = [(f.corpus, *row) for k, v in json.loads(f.value).items() for row in flat(v, "", k)]
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in LEAVES.split(", ")])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("corpus"), "value").mapInPandas(run, LEAVES)


# What a corpus must hold. path, key | least number | placeholders allowed | required, and what else is
# asked: E names no entity, R uses no rule word, P padding placeholders are allowed too.
TEMPLATES = """
nl.ADD 4 e | e
nl.ADD_BAN 4 e | e
nl.CONFLICT 4 e c | e c
nl.SUPERSEDE 4 e | e
nl.SUPPORT 4 e | e
nl.CONDITION 4 e c | e c
nl.CONDITION_WIDEN 4 e | e
nl.RETRACT 4 e g | e g
nl.GROUP_BAN 4 g | g
nl.CONFLICT_WEAK 4 e c | e c
nl.SUPPORT_BAN 4 e | e
nl.CTX_ON 4 c | c
nl.CTX_OFF 4 c | c
hnl.ALIAS 1 x y | x y
hnl.ALIAS_BREAK 1 x y | x y
hnl.GROUP_BAN_COND 1 g c roster | g c roster
hnl.JOIN 2 e g | e g
hnl.LEAVE 2 e g | e g
hnl.LIFT 2 e | e
hnl.REVERSE 2 e | e
hnl.LEAD_DEFAULT 2 e | e
hnl.SEC_BAN 2 e | e
terse.ADD 3 e | e
terse.ADD_BAN 3 e | e
terse.CONFLICT 2 e c | e c
.task_nl 4 | | E
.filler_nl 8 | | ER
noise.proposal 6 e | e
noise.hearsay 6 e | e
noise.question 6 e | e
noise.other_team 6 e | e
noise.stale_echo 6 e | e
noise.praise 6 e | e
noise.rescind 6 e | e
noise.near_miss 6 e | e
numeric.set 2 limit v u | limit v
numeric.probe 2 v u | v
numeric.ban 2 e limit | e limit
cert.rule 1 |
cert.roster 1 e roster | roster
cert.on 1 |
cert.off 1 |
cert.grant 1 e roster | e
cert.revoke 1 e roster | e
derived.PAIR 1 x y | x y
derived.ON 1 x y | y
derived.OFF 1 x y | y
.conj 1 e c1 c2 | e c1 c2
surface.session_titles 6 n date | n | E
surface.header_lines 6 n people date | | E
surface.artifacts 6 | | E
surface.action_items 24 | | ER
surface.blocks 40 | | ER
pad.side 10 | | ERP
pad.actions 6 | p | ERP
"""
# Fields that must be there, with their type; how many members lists must have (=: exactly).
FIELDS = ".key string, .title string, .setting string, .sort string, .allow string, .goal string, .persona string, entities.prefix string, tools.act.name string, tools.act.param string, tools.act.doc string, numeric.ctx string, numeric.param string, numeric.limit string, numeric.unit string, surface.you_prefix string, people.roles.1 any, people.roles.2 any, people.roles.3 any"
SIZES = "entities.names =96, entities.conditions =6, entities.groups =6, tools.read =2, numeric.values =4, surface.notice_frame =2, people.authority_terms 3, pad.first_names 30, pad.last_names 20, pad.slots 6, pad.families 5"
# Forms of single fields.
FORMS = {".key": "[a-z_]+", ".sort": "[a-z_]+", ".allow": "[a-z_]+", ".goal": "[a-z_]+", "numeric.ctx": "[a-z_]+", "entities.prefix": "[a-z]{2}", "numeric.dir": "above|below", "surface.layout": "sectioned|flat"}
PAD_SLOTS = "n_small n_few n_few2 n_weeks n_days n_min n_min_small n_people n_tickets n_k n_big pct n_pct_small hour d mon tk p p2"
RANKS = {3: 2, 2: 1, 1: 2, 0: 4}
# Words of rules, and words that claim authority.
RULE_WORDS = r"(?i)\b(approved?|approval|prohibit(ed|ion)?|bann?ed|ban\b|supersed\w*|reaffirm\w*|reinstat\w*|contraindicat\w*|deprecat\w*|forbid(den)?|may not|must not|off the list|on the list|no longer allowed|cleared for)\b"
AUTHORITY = "council|board|committee|directors?|leadership|consultants?|registrars?|coordinator|policy|signed off|sign-off|minuted at"
SPEAKER_FIXED = ("hnl.SEC_BAN", "hnl.LIFT", "hnl.LEAD_DEFAULT", "derived.PAIR")


def template_rules(spark: SparkSession) -> DataFrame:
    rows = []
    for line in TEMPLATES.strip().split("\n"):
        left, req, marks = (line.split("|") + ["", ""])[:3]
        place, least, *allowed = left.split()
        rows.append((place, int(least), sorted(set(allowed) | set(req.split())), req.split(), "E" in marks, "R" in marks, "P" in marks))
    return spark.createDataFrame(rows, "place string, least int, allowed array<string>, required array<string>, no_entity boolean, no_rule boolean, padding boolean")


def failures(found: DataFrame) -> DataFrame:
    """What is wrong with each corpus. Corpora are small; rows of one meet by equi-joins on its name."""
    spark = found.sparkSession
    rows = found.withColumn("place", F.concat("path", F.lit("."), "key"))
    corpora = rows.select("corpus").distinct()
    own = lambda place: rows.where((F.col("place") == place) & (F.col("idx") >= 0))
    at = F.concat(F.ltrim("place", F.lit(".")), F.when(F.col("idx") >= 0, F.format_string("[%d]", "idx")).otherwise(""))
    bad = lambda df, problem, where=at: df.select("corpus", where.alias("place"), problem.alias("problem"))
    text = F.lower("text")

    # templates: number, type, placeholders, entities, words
    names = own("entities.names").groupBy("corpus").agg(F.collect_set(text).alias("names"))
    extra = rows.where("path = 'pad.slots' AND idx = -1").groupBy("corpus").agg(F.collect_set("key").alias("extra"))
    fams = rows.where("path = 'pad.families' AND kind = 'list' AND idx = -1").select("corpus", "place", F.lit(8).alias("least"), F.array().cast("array<string>").alias("allowed"), F.array().cast("array<string>").alias("required"), F.lit(True).alias("no_entity"), F.lit(True).alias("no_rule"), F.lit(True).alias("padding"))
    vocab = rows.where("path = 'pad.slots' AND kind = 'list' AND idx = -1").select("corpus", "place", F.lit(8).alias("least"), F.array().cast("array<string>").alias("allowed"), F.array().cast("array<string>").alias("required"), F.lit(True).alias("no_entity"), F.lit(False).alias("no_rule"), F.lit(False).alias("padding"))
    fixed = template_rules(spark)
    suggest = rows.where("place = '.suggest' AND idx = -1").select("corpus", "place", F.lit(4).alias("least"), F.array(F.lit("e")).alias("allowed"), F.array(F.lit("e")).alias("required"), F.lit(False).alias("no_entity"), F.lit(False).alias("no_rule"), F.lit(False).alias("padding"))
    people = ["r3", "p3", "r2", "p2", "r1", "p1", "p0"]
    order = rows.where("place = '.hierarchy' AND kind <> 'null'").select("corpus", "place", F.lit(1).alias("least"), F.array(*map(F.lit, people)).alias("allowed"), F.array(*map(F.lit, people)).alias("required"), F.lit(False).alias("no_entity"), F.lit(False).alias("no_rule"), F.lit(False).alias("padding"))
    rules = corpora.join(F.broadcast(fixed)).select(*fams.columns).unionByName(fams).unionByName(vocab).unionByName(suggest).unionByName(order)
    # a single template may stand without a list
    given = rows.where("NOT (kind IN ('list', 'object') AND idx = -1)")
    one = rules.join(given, ["corpus", "place"], "left")
    counts = one.groupBy("corpus", "place", "least").agg(F.count("kind").alias("n")).where("n < least").withColumn("idx", F.lit(-1))
    each = one.where("kind IS NOT NULL").join(names, "corpus", "left").join(extra, "corpus", "left")
    each = each.withColumn("allowed", F.when(F.col("padding"), F.concat("allowed", F.split(F.lit(PAD_SLOTS), " "), F.coalesce("extra", F.array().cast("array<string>")))).otherwise(F.col("allowed")))
    good = each.where("kind = 'string' AND trim(text) <> ''")
    parts = [
        bad(counts, F.concat(F.col("n").cast("string"), F.lit(" templates, need "), F.col("least").cast("string"))),
        bad(each.where("kind <> 'string' OR trim(text) = ''"), F.lit("empty or not a string")),
        bad(good.where("broken"), F.lit("bad format string")),
        bad(good.where(F.size(F.array_except("slots", "allowed")) > 0), F.concat(F.lit("unknown placeholders "), F.array_join(F.array_except("slots", "allowed"), ","))),
        bad(good.where(~F.col("broken") & (F.size(F.array_except("required", "slots")) > 0)), F.concat(F.lit("must use "), F.array_join(F.array_except("required", "slots"), ","))),
        bad(good.where(F.col("no_entity") & F.coalesce(F.exists("names", lambda n: (n != "") & F.contains(text, n)), F.lit(False))), F.lit("names a governed entity")),
        bad(good.where(F.col("no_rule") & F.rlike("text", F.lit(RULE_WORDS))), F.lit("uses a rule word")),
    ]

    # fields, sizes, forms
    def asked(spec: str, schema: str) -> DataFrame:
        return corpora.join(F.broadcast(spark.createDataFrame([tuple(x.split(" ")) for x in spec.split(", ")], schema))).withColumn("idx", F.lit(-1))

    have = rows.where("idx = -1").select("corpus", "place", "kind", "text")
    fields = asked(FIELDS, "place string, want string").join(have, ["corpus", "place"], "left")
    sizes = asked(SIZES, "place string, want string").join(have, ["corpus", "place"], "left").withColumn("n", F.when(F.col("kind").isin("list", "object"), F.col("text").cast("int")))
    forms = corpora.join(F.broadcast(spark.createDataFrame(list(FORMS.items()), "place string, form string"))).withColumn("idx", F.lit(-1)).join(have, ["corpus", "place"], "left")
    wanted = F.regexp_replace("want", "=", "").cast("int")
    parts += [
        bad(fields.where("kind IS NULL OR (want <> 'any' AND kind <> want)"), F.lit("missing or of the wrong type")),
        bad(fields.where(F.startswith("place", F.lit(".")) & (F.col("kind") == "string") & (F.trim("text") == "")), F.lit("empty")),
        bad(sizes.where(F.col("n").isNull() | (F.startswith("want", F.lit("=")) & (F.col("n") != wanted)) | (F.col("n") < wanted)), F.concat(F.lit("has "), F.coalesce(F.col("n").cast("string"), F.lit("no")), F.lit(" members, need "), F.col("want"))),
        bad(forms.where(F.coalesce(F.col("text"), F.lit("")) == "").where("place IN ('numeric.dir', 'surface.layout')"), F.lit("missing")),
        bad(forms.where("kind = 'string' AND text <> ''").where(~F.expr("text rlike concat('^(', form, ')$')")), F.concat(F.lit("must match "), F.col("form"))),
    ]

    # entities: no name twice, none within another
    entity = own("entities.names").select("corpus", "place", "idx", F.trim(text).alias("name"))
    other = entity.select("corpus", F.col("idx").alias("j"), F.col("name").alias("longer"))
    parts += [
        bad(entity.groupBy("corpus", "place", "name").agg(F.count(F.lit(1)).alias("n"), F.lit(-1).alias("idx")).where("n > 1"), F.concat(F.lit("twice: "), "name")),
        bad(entity.join(other, "corpus").where("idx <> j AND name <> '' AND contains(longer, name)").groupBy("corpus", "place", "idx").agg(F.min("longer").alias("longer")), F.concat(F.lit("part of "), "longer")),
    ]

    # people: ranks, how many of each, descriptions, names that padding also uses
    start = rows.where("path = 'people.start'")
    rank = start.select("corpus", "key", F.when(F.col("kind") == "int", F.col("text").cast("int")).alias("r"), "place", "idx")
    need = corpora.join(F.broadcast(spark.createDataFrame(list(RANKS.items()), "r int, least int"))).join(rank.groupBy("corpus", "r").agg(F.count(F.lit(1)).alias("n")), ["corpus", "r"], "left").withColumns({"place": F.lit("people.start"), "idx": F.lit(-1)})
    described = rows.where("path = 'people.descr'").select("corpus", "key")
    parts += [
        bad(rank.where("r IS NULL OR r NOT BETWEEN 0 AND 3"), F.lit("rank must be 0 to 3")),
        bad(need.where("coalesce(n, 0) < least"), F.concat(F.lit("too few people of rank "), F.col("r").cast("string"))),
        bad(rank.where("r = 0").join(described, ["corpus", "key"], "left_anti"), F.lit("no description")),
        bad(own("pad.first_names").join(start.select("corpus", F.col("key").alias("text")), ["corpus", "text"], "left_semi"), F.lit("is also a speaker")),
    ]

    # texts that speakers of any rank may say claim no authority
    escape = lambda c: F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    terms = own("people.authority_terms").where("kind = 'string' AND trim(text) <> ''").groupBy("corpus").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.trim("text"))), escape), "|").alias("terms"))
    said = rows.where(F.col("path").isin("nl", "hnl", "terse") | F.col("place").isin("numeric.set", "numeric.ban", "derived.ON", "derived.OFF", ".conj")).where(F.col("kind") == "string").where(~F.col("place").isin(*SPEAKER_FIXED)).join(terms, "corpus", "left")
    claim: Column = F.concat(F.lit(r"(?i)(?<![A-Za-z])(" + AUTHORITY), F.coalesce(F.concat(F.lit("|"), "terms"), F.lit("")), F.lit(r")(?![A-Za-z])"))
    parts.append(bad(said.where(F.rlike("text", claim)), F.lit("claims authority")))

    # single checks
    field = lambda place: F.max(F.when((F.col("place") == place) & (F.col("idx") == -1), F.col("text")))
    whole = lambda place: F.max(F.when((F.col("place") == place) & (F.col("idx") == -1) & (F.col("kind") == "int"), F.col("text").cast("long")))
    head = rows.groupBy("corpus").agg(field("tools.act.param").alias("act"), field(".sort").alias("sort"), field("cert.rule").alias("rule"), field("surface.layout").alias("layout"), whole("numeric.lo").alias("lo"), whole("numeric.hi").alias("hi"))
    values = own("numeric.values").groupBy("corpus").agg(F.countDistinct("text").alias("n"), F.bool_and(F.col("kind") == "int").alias("whole"), F.count(F.lit(1)).alias("m"))
    inside = own("numeric.values").where("kind = 'int'").join(head.select("corpus", "lo", "hi"), "corpus").where("cast(text AS bigint) <= lo OR cast(text AS bigint) >= hi")
    sections = corpora.withColumn("place", F.explode(F.array(*(F.lit(f"surface.sections.{k}") for k in ("discussion", "decisions", "actions"))))).withColumn("idx", F.lit(-1)).join(have, ["corpus", "place"], "left").join(head.select("corpus", "layout"), "corpus")
    tool = own("tools.read").select("corpus", F.col("idx").alias("i")).distinct().select("corpus", "i", F.explode(F.array(*map(F.lit, ("name", "param", "doc")))).alias("key"))
    tool_has = rows.where("path = 'tools.read' AND kind = 'string'").select("corpus", F.col("idx").alias("i"), "key")
    n_lines = F.size(F.split("text", "\n"))
    slot_names = rows.where("path = 'pad.slots' AND idx = -1")
    parts += [
        bad(head.where("act IS DISTINCT FROM sort"), F.lit("differs from sort"), F.lit("tools.act.param")),
        bad(head.where("rule IS NOT NULL AND NOT lower(rule) LIKE '%violation%' AND NOT lower(rule) LIKE '%breach%'"), F.lit("must call off-list use a violation or breach"), F.lit("cert.rule")),
        bad(head.where("NOT coalesce(lo < hi, false)"), F.lit("whole numbers, lo below hi"), F.lit("numeric.lo/hi")),
        bad(values.where("n < m OR NOT whole"), F.lit("distinct whole numbers"), F.lit("numeric.values")),
        bad(inside, F.lit("not inside lo and hi")),
        bad(sections.where("kind IS NULL OR kind <> 'list' OR (layout = 'sectioned' AND cast(text AS int) < 3)"), F.lit("a list, of three headers where sectioned")),
        bad(tool.join(tool_has, ["corpus", "i", "key"], "left_anti"), F.lit("missing"), F.format_string("tools.read[%d].%s", "i", "key")),
        bad(own("surface.blocks").where("kind = 'string'").where((n_lines < 3) | (n_lines > 6)), F.lit("three to six lines")),
        bad(own("surface.notice_frame").where("kind <> 'string'"), F.lit("not a string")),
        bad(slot_names.where(~F.rlike("key", F.lit("^[a-z_]+$")) | F.array_contains(F.split(F.lit(PAD_SLOTS), " "), F.col("key"))), F.lit("reserved or not snake_case")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
