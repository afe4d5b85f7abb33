"""Configuration tables as DataFrames.

Every table is a literal ``VALUES`` relation, so Spark knows its exact size and
decides by itself (``spark.sql.autoBroadcastJoinThreshold``) to broadcast it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex import rules


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def table(spark: SparkSession, ddl: str, rows: Iterable[Sequence]) -> DataFrame:
    """A small literal table with the given schema, e.g. ``"a string, n int"``."""
    rows = list(rows)
    fields = [part.strip().split(None, 1) for part in _split_ddl(ddl)]
    casts = ", ".join(f"CAST(`{n}` AS {t}) AS `{n}`" for n, t in fields)
    names = ", ".join(f"`{n}`" for n, _ in fields)
    if not rows:
        nulls = ", ".join("NULL" for _ in fields)
        return spark.sql(f"SELECT {casts} FROM VALUES ({nulls}) AS t({names}) WHERE false")
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def _split_ddl(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return parts + [current]


def orders(spark: SparkSession, rows: dict[str, str] | None = None) -> DataFrame:
    """``(filetype, order)``: one order string per filetype."""
    return table(spark, "filetype string, order string",
                 (rows if rows is not None else rules.KIND_ORDER).items())


def kind_priority(order_table: DataFrame) -> DataFrame:
    """``(filetype, kind, prio)``: position of each kind in its order string."""
    return order_table.select(
        "filetype", F.posexplode(F.split("order", "")).alias("prio", "kind")
    ).filter("kind <> ''").select("filetype", "kind", "prio")


def equivalents(spark: SparkSession, rows: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """``(filetype, kind_from, kind_to)``."""
    rows = rows if rows is not None else rules.KIND_EQUIVALENT
    return table(spark, "filetype string, kind_from string, kind_to string",
                 [(ft, a, b) for ft, pairs in rows.items() for a, b in pairs.items()])


RULE_DDL = ("filetype string, kind string, group string, prefix string, suffix string, "
            "notin array<string>, allow_keyword int")


def group_rules(spark: SparkSession, rows: Iterable[Sequence] | None = None) -> DataFrame:
    """Rule table; each row is (filetype, kind, group, prefix, suffix, notin, allow_keyword)."""
    if rows is None:
        rows = [(ft, k, g, p, s, None, a) for ft, k, g, p, s, a in rules.GROUP_RULES]
    return table(spark, RULE_DDL, rows)


def overlay_orders(defaults: DataFrame, user: DataFrame) -> DataFrame:
    """User order strings replace or extend the defaults."""
    return (defaults.withColumnRenamed("order", "_default")
            .join(user.withColumnRenamed("order", "_user"), "filetype", "full_outer")
            .select("filetype", F.coalesce("_user", "_default").alias("order")))


def overlay_rules(defaults: DataFrame, user: DataFrame) -> DataFrame:
    """User rules replace the default rule of the same (filetype, kind) or extend the table.

    A user rule wins as a whole, so leaving its prefix empty means the default border.
    """
    given = user.withColumn("_given", F.lit(True)).alias("u")
    base = defaults.alias("d")
    joined = base.join(given, ["filetype", "kind"], "full_outer")
    pick = [F.when(F.col("_given"), F.col(f"u.{c}")).otherwise(F.col(f"d.{c}")).alias(c)
            for c in ("group", "prefix", "suffix", "notin", "allow_keyword")]
    return joined.select("filetype", "kind", *pick)


def overlay_equivalents(defaults: DataFrame, user: DataFrame) -> DataFrame:
    """A filetype named in the user table has only the user's equivalents."""
    kept = defaults.join(user.select("filetype").distinct(), "filetype", "left_anti")
    return kept.unionByName(user)


def language_map(spark: SparkSession, rows: Iterable[Sequence] | None = None) -> DataFrame:
    """``(ctags_lang, filetype)``; several rows may name the same language."""
    return table(spark, "ctags_lang string, filetype string",
                 rows if rows is not None else rules.LANGUAGE_FILETYPE)


def languages(spark: SparkSession) -> DataFrame:
    return table(spark, "filetype string, language string", rules.LANGUAGES)


def comment_families(spark: SparkSession) -> DataFrame:
    return table(spark, "language string, family string",
                 [(lang, fam) for fam, langs in rules.COMMENT_FAMILY.items() for lang in langs])


def extensions(spark: SparkSession) -> DataFrame:
    return table(spark, "filetype string, ext string",
                 [(ft, e) for ft, exts in rules.FILETYPE_EXTENSIONS.items() for e in exts])


def group_links(spark: SparkSession, rows: Iterable[Sequence] | None = None) -> DataFrame:
    return table(spark, "src string, dst string",
                 rows if rows is not None else rules.GROUP_LINKS)


def event_actions(spark: SparkSession, rows: Iterable[Sequence] | None = None) -> DataFrame:
    return table(spark, "event string, action string, forced boolean",
                 rows if rows is not None else rules.EVENT_ACTIONS)


def ignored_names(spark: SparkSession, rows: dict[str, list[str]]) -> DataFrame:
    """``(filetype, name)`` rows of the per-filetype ignore lists."""
    return table(spark, "filetype string, name string",
                 [(ft, n) for ft, names in rows.items() for n in names])
