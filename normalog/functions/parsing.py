"""Parsing of what models and people write: column functions, and queries that apply them to texts made of the tables.

The SQL of each query is written by itself, not made of the functions, so the two check one another.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normalog.plans import library

# Words read as no and as yes, and the replies that stand for no script.
NO = ("false", "no", "off", "0", "f", "n", "none", "")
YES = ("true", "yes", "on", "1", "t", "y")
NO_SCRIPT = r"(?i)^\(\s*(?:LLM (?:returned empty response|call error|call failed)|Script generation (?:failed|error)|No (?:trace available to generate script|script available))"
OPTIONS_TAIL = r"\bThe only options open to you\b"
#: An object of a JSON list, with strings and one level of objects inside.
STRING = r'"(?:[^"\\]|\\.)*"'
OBJECT = rf"\{{(?:[^{{}}\"]|{STRING}|\{{(?:[^{{}}\"]|{STRING})*\}})*\}}"


def norm(s: Column) -> Column:
    """Lower case, single blanks, without a leading article."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), r"\s+", " ")), r"^(?:the|a|an)\s+", "")


def speaker_key(s: Column) -> Column:
    return norm(F.regexp_replace(F.trim(F.coalesce(s, F.lit(""))), ":+$", ""))


def flag(s: Column, default: bool = True) -> Column:
    """A yes or no, however written; null and other words give the default."""
    word = F.lower(F.trim(s))
    return F.when(word.isin(*NO), False).when(word.isin(*YES), True).otherwise(F.lit(default))


def whole(s: Column) -> Column:
    """The first number of a text, cut to a whole one; the word session is no part of it."""
    return F.nullif(F.regexp_extract(F.replace(F.lower(s), F.lit("session"), F.lit("")), r"-?\d+(?:\.\d+)?", 0), F.lit("")).cast("double").cast("long")


def members(s: Column) -> Column:
    """The named members of a list written with commas, semicolons or and; blank ones go."""
    return F.filter(F.split(s, "[,;]| and "), lambda x: F.trim(x) != "")


def fenced_json(s: Column) -> Column:
    """From the first { to the last } of a reply without its fences; null without such."""
    bare = F.regexp_replace(F.trim(s), "```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def whole_objects(s: Column, name: str) -> Column:
    """The complete objects of a list in a reply that may be cut off, in order."""
    upto = F.regexp_extract(s, rf'(?s)"{name}"[^\[]*\[((?:[^{{\]]*{OBJECT})*)', 1)
    return F.regexp_extract_all(upto, F.lit(OBJECT), F.lit(0))


def unusable(s: Column) -> Column:
    """Whether a script is empty, but for its tags, or a reply that stands for none."""
    bare = F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), "</?script>", ""))
    return (bare == "") | bare.rlike(NO_SCRIPT)


def task_key(s: Column) -> Column:
    """A task's stem: without its speaker, the offered options and digits."""
    own = F.regexp_replace(F.trim(s), r"^[A-Z][\w .'\-]{0,40}:\s", "")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.split(own, OPTIONS_TAIL, 2)[0], r"\d+", "")), r"\s+", " "))


def literal(s: Column) -> Column:
    """(neg, pred, args) of a written literal."""
    neg = F.startswith(F.trim(s), F.lit("~"))
    core = F.trim(F.when(neg, F.substring(F.trim(s), F.lit(2), F.length(s))).otherwise(F.trim(s)))
    rest = F.regexp_replace(F.regexp_extract(core, r"\((.*)$", 1), r"\)+$", "")
    args = F.filter(F.transform(F.split(rest, ","), lambda a: F.trim(a)), lambda a: a != "")
    return F.struct(neg.alias("neg"), F.trim(F.split(core, r"\(")[0]).alias("pred"), args.alias("args"))


def rendered(lit: Column) -> Column:
    core = F.when(F.size(lit["args"]) > 0, F.concat(lit["pred"], F.lit("("), F.array_join(lit["args"], ","), F.lit(")"))).otherwise(lit["pred"])
    return F.concat(F.when(lit["neg"], "~").otherwise(""), core)


def complement(lit: Column) -> Column:
    return lit.withField("neg", ~lit["neg"])


def placeholders(s: Column) -> Column:
    """The distinct slots of a template."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(r"\{([a-z_0-9]*)\}"), F.lit(1))))


def offered(options: Column, most: int = 6) -> Column:
    """Distinct options in their order, six at most."""
    return F.slice(F.array_distinct(options), 1, most)


def flat_args(args: Column) -> Column:
    """What a call's arguments say, in their order."""
    return F.array_join(F.map_values(args), " ")


def short_name(episode: Column) -> Column:
    """An episode's id without its first two parts and its last."""
    return F.regexp_extract(episode, "^[^_]*_[^_]*_(.*)_[^_]*$", 1)


def harness_failure(error: Column, n_calls: Column, n_reads: Column, text: Column) -> Column:
    """Whether a step failed for reasons that are not the agent's."""
    err = F.coalesce(error, F.lit(""))
    silent = (F.coalesce(n_calls, F.lit(0)) == 0) & (F.coalesce(n_reads, F.lit(0)) == 0) & F.coalesce(text, F.lit("")).isin("", "None")
    return F.startswith(err, F.lit("HTTP")) | F.startswith(err, F.lit("empty completion")) | silent


def weighed(weight: Column, tier: Column) -> Column:
    """A task without a difficulty weighs 1 and has the tier ?."""
    return F.struct(F.coalesce(weight, F.lit(1.0)).alias("weight"), F.coalesce(tier, F.lit("?")).alias("span_tier"))


def tool_schema(name: Column, doc: Column, params: Column) -> Column:
    """A tool as a function's JSON schema. params: map of name to type."""
    kinds = F.transform_values(params, lambda k, v: F.struct(v.alias("type")))
    body = F.struct(F.lit("object").alias("type"), kinds.alias("properties"), F.map_keys(params).alias("required"))
    return F.to_json(F.struct(F.lit("function").alias("type"), F.struct(name.alias("name"), doc.alias("description"), body.alias("parameters")).alias("function")))


#: The texts the queries read: (id, x, ...), in the SQL of both engines.
TEXTS = {
    "speaker": "SELECT conv_id * 100 + turn AS id, CASE turn % 4 WHEN 0 THEN concat('  The   ', role, ':: ') WHEN 1 THEN concat('Ms. ', upper(role), ' :') WHEN 2 THEN concat('an ', role) ELSE NULL END AS x FROM conversations",
    "flag": "SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN ' No ' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'maybe' WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN 'off' WHEN 6 THEN 'y' WHEN 7 THEN '0' ELSE event_type END AS x FROM events",
    "number": "SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN concat('Session ', event_id) WHEN 1 THEN concat('-', event_id, '.75 tons') WHEN 2 THEN 'none' WHEN 3 THEN NULL WHEN 4 THEN concat('between ', event_id, ' and 9') ELSE concat('', event_id) END AS x FROM events",
    "members": "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN concat(c_name, '; ', c_mktsegment, ' and ', c_custkey, ',, ') WHEN 1 THEN c_name ELSE ' ' END AS x FROM customer",
    "reply": "SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN concat('```json', chr(10), '{\"statements\": [', page_id, ']}', chr(10), '```') WHEN 1 THEN 'no json' WHEN 2 THEN concat('text {\"a\": {\"b\": ', page_id, '}} tail }.') WHEN 3 THEN '} {' ELSE NULL END AS x FROM pages",
    "cut": "SELECT page_id AS id, concat('{\"memory list\": [{\"key\": \"k', page_id, '\", \"value\": \"v {x} ]\"}, {\"o\": {\"n\": 1}}, ', CASE page_id % 3 WHEN 0 THEN '{\"key\": \"b' WHEN 1 THEN '{\"key\": 2}], \"more\": [{\"z\": 1}]}' ELSE '' END) AS x FROM pages",
    "script": "SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '<script> </script>' WHEN 2 THEN '(LLM call error: timeout)' WHEN 3 THEN '( script generation FAILED)' WHEN 4 THEN NULL WHEN 5 THEN concat('<script>1. ', event_type) ELSE '(a script) that works' END AS x FROM events",
    "task": "SELECT conv_id * 100 + turn AS id, concat(CASE turn % 3 WHEN 0 THEN 'Ann Lee: ' WHEN 1 THEN '  O''Neil-Smith: ' ELSE 'then: ' END, 'Please  move ', conv_id, ' items in room ', turn, CASE WHEN turn % 2 = 0 THEN concat('. The only options open to you: ', role) ELSE ' now' END) AS x FROM conversations",
    "literal": "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN concat('~ok(A', o_custkey, ')') WHEN 1 THEN 'deploy_ok' WHEN 2 THEN concat(' blocked( ?V , q', o_custkey, ') ') WHEN 3 THEN '~ low_budget' WHEN 4 THEN 'p()' ELSE concat('pair(a,', o_custkey, ')') END AS x FROM orders",
    "template": "SELECT p_partkey AS id, concat(p_name, ' {e} costs {price_', p_size, '} and {e} {', p_brand, '} {}') AS x FROM part",
    "options": "SELECT user_id AS id, event_id, event_id % 9 AS x FROM events",
    "episode": "SELECT event_id AS id, concat('rev_w', event_id % 7, '_', event_type, CASE WHEN event_id % 3 = 0 THEN '_b' ELSE '' END, '_', user_id) AS x FROM events",
    "step": "SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN concat('HTTP ', 500 + user_id % 10) WHEN 1 THEN 'empty completion (200)' WHEN 2 THEN 'no action in response' ELSE NULL END AS error, event_id % 3 AS n_calls, event_id % 2 AS n_reads, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'None' ELSE event_type END AS x FROM events",
    "weight": "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 5e-1 * (event_id % 7) END AS w, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS x FROM events",
    "tool": "SELECT p_partkey AS id, p_name, p_type, p_brand FROM part",
    "event": "SELECT event_id AS id, user_id, event_type, value, props FROM events",
}
JOINED = "|"


def joined(items: Column) -> Column:
    return F.array_join(items, JOINED)


def told(spark: SparkSession, sf_dir: str, name: str, columns: Callable[[], list[Column]]) -> DataFrame:
    return library.run(spark, sf_dir, TEXTS[name]).select("id", *columns())


def options_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The options each user was offered, in order, by name where the nation has one."""
    asked = library.run(spark, sf_dir, TEXTS["options"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("event_id", "x"))).alias("o"))
    own = asked.select("id", F.posexplode(offered(F.transform("o", lambda x: x["x"]))).alias("place", "x"))
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("x"), "n_name")
    return own.join(F.broadcast(names), "x", "left").select("id", "place", "x", "n_name")


def event_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON and read back."""
    rows = library.run(spark, sf_dir, TEXTS["event"])
    read = F.from_json(F.to_json(F.struct("id", "user_id", "event_type", "value", "props")), "id long, user_id long, event_type string, value double, props string")
    return rows.select(read.alias("e")).select("e.*")


X = F.col
_lit = lambda: literal(F.col("x"))
COLUMNS: dict[str, tuple[str, Callable[[], list[Column]]]] = {
    "speaker_key": ("speaker", lambda: [speaker_key(X("x")).alias("who")]),
    "tolerant_flag": ("flag", lambda: [flag(X("x")).alias("yes"), flag(X("x"), False).alias("sure")]),
    "first_number": ("number", lambda: [whole(X("x")).alias("n")]),
    "list_members": ("members", lambda: [joined(members(X("x"))).alias("names")]),
    "fenced_json": ("reply", lambda: [fenced_json(X("x")).alias("body")]),
    "salvaged_objects": ("cut", lambda: [joined(whole_objects(X("x"), "memory list")).alias("objects")]),
    "unusable_scripts": ("script", lambda: [unusable(X("x")).alias("bad")]),
    "task_key": ("task", lambda: [task_key(X("x")).alias("task")]),
    "literal_parse": ("literal", lambda: [_lit()["neg"].alias("neg"), _lit()["pred"].alias("pred"), joined(_lit()["args"]).alias("args")]),
    "literal_render": ("literal", lambda: [rendered(_lit()).alias("written"), rendered(complement(_lit())).alias("other"), (~F.exists(_lit()["args"], lambda a: F.startswith(a, F.lit("?")))).alias("ground")]),
    "placeholders": ("template", lambda: [joined(placeholders(X("x"))).alias("slots")]),
    "episode_short_name": ("episode", lambda: [short_name(X("x")).alias("short")]),
    "harness_failures": ("step", lambda: [harness_failure(X("error"), X("n_calls"), X("n_reads"), X("x")).alias("failed"), ((X("n_calls") > 0) | ~harness_failure(X("error"), X("n_calls"), X("n_reads"), X("x"))).alias("graded")]),
    "default_weight": ("weight", lambda: [weighed(X("w"), X("x"))["weight"].alias("weight"), weighed(X("w"), X("x"))["span_tier"].alias("span_tier")]),
    "tool_schema": ("tool", lambda: [tool_schema(X("p_name"), X("p_type"), F.create_map("p_brand", F.lit("string"))).alias("schema")]),
    "args_flattening": ("tool", lambda: [flat_args(F.create_map(F.lit("b"), X("p_brand"), F.lit("a"), X("p_name"))).alias("said")]),
}
QUERIES = {name: partial(told, name=text, columns=columns) for name, (text, columns) in COLUMNS.items()} | {"option_names": options_of, "event_json_round_trip": event_round_trip}

_SQL = {
    "speaker_key": ("speaker", "SELECT id, regexp_replace(regexp_replace(trim(lower(rtrim(trim(coalesce(x, '')), ':'))), '\\s+', ' ', 'g'), '^(the|a|an) ', '') AS who FROM i"),
    "tolerant_flag": ("flag", "SELECT id, lower(trim(coalesce(x, 'yes'))) NOT IN ('false', 'no', 'off', '0', 'f', 'n', 'none', '') AS yes, coalesce(lower(trim(x)) IN ('true', 'yes', 'on', '1', 't', 'y'), false) AS sure FROM i"),
    "first_number": ("number", "SELECT id, CASE WHEN regexp_matches(x, '[0-9]') THEN trunc(CAST(regexp_extract(x, '-?[0-9]+(\\.[0-9]+)?') AS DOUBLE))::BIGINT END AS n FROM i"),
    "list_members": ("members", "SELECT id, array_to_string([y FOR y IN string_split(replace(replace(x, ';', ','), ' and ', ','), ',') IF trim(y) <> ''], '|') AS names FROM i"),
    "fenced_json": ("reply", "SELECT id, CASE WHEN position('{' IN x) > 0 AND length(x) - position('}' IN reverse(x)) + 1 > position('{' IN x) THEN substr(x, position('{' IN x), length(x) - position('}' IN reverse(x)) + 2 - position('{' IN x)) END AS body FROM i"),
    "salvaged_objects": ("cut", "SELECT id, concat('{\"key\": \"k', id, '\", \"value\": \"v {x} ]\"}|{\"o\": {\"n\": 1}}', CASE WHEN id % 3 = 1 THEN '|{\"key\": 2}' ELSE '' END) AS objects FROM i"),
    "unusable_scripts": ("script", "SELECT id, id % 7 <= 4 AS bad FROM i"),
    "task_key": ("task", "SELECT id, concat(CASE WHEN id % 100 % 3 = 2 THEN 'then: ' ELSE '' END, 'please move items in room', CASE WHEN id % 100 % 2 = 0 THEN ' .' ELSE ' now' END) AS task FROM i"),
    "literal_parse": ("literal", "SELECT id, ltrim(x)[1] = '~' AS neg, trim(string_split(ltrim(x, ' ~'), '(')[1]) AS pred, CASE WHEN position('(' IN x) > 0 THEN array_to_string([trim(a) FOR a IN string_split(rtrim(string_split(trim(x), '(')[2], ')'), ',') IF trim(a) <> ''], '|') ELSE '' END AS args FROM i"),
    "literal_render": ("literal", "SELECT id, w AS written, CASE WHEN w[1] = '~' THEN substr(w, 2) ELSE concat('~', w) END AS other, position('?' IN w) = 0 AS ground FROM (SELECT id, replace(replace(x, ' ', ''), '()', '') AS w FROM i)"),
    "placeholders": ("template", "SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '\\{([a-z_0-9]*)\\}', 1))), '|') AS slots FROM i"),
    "episode_short_name": ("episode", "SELECT id, array_to_string(string_split(x, '_')[3:-2], '_') AS short FROM i"),
    "harness_failures": ("step", "SELECT id, f AS failed, n_calls > 0 OR NOT f AS graded FROM (SELECT *, id % 8 IN (0, 1) OR (n_calls = 0 AND n_reads = 0 AND id % 5 IN (0, 1, 2)) AS f FROM i)"),
    "default_weight": ("weight", "SELECT id, ifnull(w, 1.0)::DOUBLE AS weight, ifnull(x, '?') AS span_tier FROM i"),
    "tool_schema": ("tool", "SELECT id, to_json({'type': 'function', 'function': {'name': p_name, 'description': p_type, 'parameters': {'type': 'object', 'properties': json_object(p_brand, {'type': 'string'}), 'required': [p_brand]}}})::VARCHAR AS schema FROM i"),
    "args_flattening": ("tool", "SELECT id, p_brand || ' ' || p_name AS said FROM i"),
    "option_names": ("options", "SELECT f.id, f.place, f.x, n_name FROM (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY min(event_id)) - 1 AS place FROM i GROUP BY id, x) f LEFT JOIN nation ON n_nationkey = f.x WHERE place < 6"),
    "event_json_round_trip": ("event", "SELECT * FROM i"),
}
SQL = {name: f"WITH i AS ({TEXTS[text]})\n{sql}" for name, (text, sql) in _SQL.items()}
