"""Named relations over the driver's tables, composed into one statement each.

A statement names the relations it needs; ``compose`` puts their definitions, and what those need, in front of it as
common table expressions. Catalyst then sees one declarative plan: unused columns are pruned through it and filters
reach the scans. Marks in braces stand for what differs between Spark SQL and the checking engine's SQL.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from normalog.sources import scratch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: mark: (Spark, DuckDB); {0}, {1} are the mark's arguments.
MARKS = {
    "json_k": ("cast(get_json_object(props, '$.k') AS int)", "cast(json_extract_string(props, '$.k') AS int)"),
    "set": ("array_join(array_sort(collect_set({0})), ',')", "coalesce(array_to_string(list_sort(list(DISTINCT {0}) FILTER ({0} IS NOT NULL)), ','), '')"),
    "list": ("array_join(transform(array_sort(collect_list(struct({1}, {0}))), x -> x.col2), ',')", "coalesce(string_agg({0}, ',' ORDER BY {1}), '')"),
    "div": ("({0} div {1})", "({0} // {1})"),
    "sub": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "get": ("regexp_extract({0}, {1}, {2})", "regexp_extract({0}, {1}, {2})"),
    "rows": ("explode({0})", "unnest({0})"),
    "arr": ("array({0})", "[{0}]"),
    "series": ("sequence({0}, {1})", "generate_series({0}, {1})"),
    "has": ("array_contains({0}, {1})", "list_contains({0}, {1})"),
    "at": ("element_at({0}, cast({1} AS int))", "({0})[{1}]"),
    "md5tail": ("cast(conv(right(md5({0}), 3), 16, 10) AS bigint)", "cast(('0x' || right(md5({0}), 3)) AS bigint)"),
    "tokens": ("regexp_extract_all({0}, '[a-z0-9][a-z0-9\\x27-]+', 0)", "regexp_extract_all({0}, '[a-z0-9][a-z0-9\\x27-]+')"),
    "pairs": ("concat({0}, zip_with(slice({0}, 1, greatest(size({0}) - 1, 0)), slice({0}, 2, greatest(size({0}) - 1, 0)), (x, y) -> concat(x, '_', y)))", "list_concat({0}, [concat(({0})[i], '_', ({0})[i + 1]) FOR i IN range(1, len({0}))])"),
    "dot": ("aggregate(zip_with({0}, {1}, (x, y) -> cast(x AS double) * cast(y AS double)), 0D, (s, v) -> s + v)", "list_sum([cast(x AS double) * cast(({1})[i] AS double) FOR x, i IN {0}])"),
    "right": ("right({0}, {1})", "right({0}, {1})"),
    "minute": ("date_trunc('hour', {0})", "date_trunc('hour', {0})"),
    "strip": ("trim(BOTH {0} FROM {1})", "trim({1}, {0})"),
    "sha": ("sha2({0}, 256)", "sha256({0})"),
    "every": ("bool_and({0})", "bool_and({0})"),
}

RELATIONS: dict[str, str] = {}
#: Relations worth writing once where a statement uses them several times, each after those it needs.
WRITTEN = ("timeline", "status_points", "judged", "weighted")


def relation(name: str, sql: str) -> None:
    RELATIONS[name] = sql.strip()


def marked(sql: str, side: int) -> str:
    """Replace {mark|a|b} from the inside out."""
    pattern = re.compile(rf"\{{({'|'.join(MARKS)})((?:\|[^{{}}]*)?)\}}")
    while m := pattern.search(sql):
        args = [a.strip() for a in m[2][1:].split("|")] if m[2] else []
        sql = sql[: m.start()] + MARKS[m[1]][side].format(*args) + sql[m.end() :]
    return sql


def named(text: str, relations: dict[str, str]) -> dict[str, int]:
    """How often the text names each relation."""
    return {n: len(found) for n in relations if (found := re.findall(rf"\b{n}\b", text))}


def compose(sql: str, side: int, given: dict[str, str] | None = None) -> str:
    """The statement with every relation it names, directly or not, defined in front of it. side: 0 Spark, 1 DuckDB.

    given: definitions that stand in place of the relations' own, or for tables.
    """
    relations, order = RELATIONS | (given or {}), []

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for name in named(text, relations):
            if name not in seen and name not in order:
                visit(relations[name], (*seen, name))
                order.append(name)

    visit(sql, ())
    head = ",\n".join(f"{n} AS ({relations[n]})" for n in order)
    text = marked((f"WITH {head}\n" if order else "") + sql.strip(), side)
    # Spark reads a backslash in a literal as an escape
    return text if side else text.replace("\\", "\\\\")


def uses(text: str, target: str) -> int:
    """How often a statement's plan holds the relation once all others are put in place of their names."""
    return sum(n * (1 if name == target else uses(RELATIONS[name], target)) for name, n in named(text, RELATIONS).items())


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The statement over the tables of sf_dir.

    What its plan would hold several times of ``WRITTEN`` is computed once, written to the session's shared folder and
    read back. Names are bound when the statement is analysed, here, under views that go afterwards.
    """
    mark = uuid.uuid4().hex[:12]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", compose(sql, 0))}

    def ask(statement: str) -> DataFrame:
        own = {n: f"SELECT * FROM {n}_{mark}" for n in frames}
        text = compose(statement, 0, own)
        views = [n for n in frames if f"{n}_{mark}" in text]
        for n in views:
            frames[n].createOrReplaceTempView(f"{n}_{mark}")
        try:
            return spark.sql(text)
        finally:
            for n in views:
                spark.catalog.dropTempView(f"{n}_{mark}")

    for name in WRITTEN:
        if uses(sql, name) > 1:
            found, path = ask(f"SELECT * FROM {name}"), scratch.folder(spark, name)
            found.write.parquet(path)
            frames[name] = spark.read.schema(found.schema).parquet(path)
    return ask(sql)
