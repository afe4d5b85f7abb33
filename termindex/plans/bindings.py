"""Roles of the test tables: which table plays corpus, catalogue, registry, events.

There is no source code in the tables, so prose plays the documents and the
names of the catalogue are words of another table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex import config as cfg
from termindex import rules as defaults
from termindex.functions import text as tx
from termindex.operators.corpus import spread
from termindex.operators.projects import fold_registry
from termindex.streaming.events import route

CHUNK = 16
NORECURSE = [*defaults.NORECURSE_DIRS, "/src3/de", "/src5/en"]
LINE_RULES = [
    ("C", r"^([A-Z][a-z]+) ", 1, "f"),
    ("C++", r"^([A-Z][a-z]+) ([a-z]+) ", 2, "v"),
    ("Python", r"^([A-Z][a-z]+),? ([a-z]+)", 1, "c"),
    ("Go", r"([a-z]+)\.$", 1, "m"),
]
EXTRA_LINE_RULES = [
    ("C", r"([A-Za-z]+)\.$", 1, "t"),
    ("Python", r" ([a-z]+), ", 1, "v"),
]
# (filetype, kind, group, prefix, suffix, notin, allow_keyword)
USER_RULES = [
    ("go", "f", "goCallTag", None, None, ["jsx.*", ".*Comment.*"], None),
    ("python", "c", "pythonTypeTag", None, None, None, 0),
    ("python", "x", "pythonExtraTag", r"\<x_", None, None, 1),
]
USER_ORDERS = {"python": "cmfvx", "go": "fpts"}
EVENT_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                "value double, props string")
TOGGLE = [*defaults.EVENT_ACTIONS, ("Toggle", "toggle", False)]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _choice(column: Column, pairs: list[tuple], other) -> Column:
    out = None
    for key, value in pairs:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out.otherwise(F.lit(other) if isinstance(other, str) else other)


def filetype() -> Column:
    return _choice(F.col("lang"), [("en", "c"), ("de", "cpp"), ("fr", "python")], "go")


def language() -> Column:
    return _choice(F.col("lang"), [("en", "C"), ("de", "C++"), ("fr", "Python")], "Go")


def extension() -> Column:
    turn = F.col("doc_id") % 3
    main = _choice(F.col("lang"), [("en", "c"), ("de", "cpp"), ("fr", "py")], "go")
    second = _choice(F.col("lang"), [("en", "h"), ("de", "hpp"), ("fr", "pyi")], "mod")
    return F.when(turn == 0, main).when(turn == 1, second).otherwise(main)


def corpus(spark: SparkSession, sf: str, text: Column | None = None) -> DataFrame:
    """(doc_id, path, filetype, lang, text) from ``documents``.

    A made-up text is built after the rows are spread, not moved with them.
    """
    docs = read(spark, sf, "documents")
    docs = docs if text is None else spread(docs.select("doc_id", "source", "lang", "text"))
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc"),
                    F.col("doc_id").cast("string"), F.lit("."), extension())
    return docs.select("doc_id", path.alias("path"), filetype().alias("filetype"),
                       language().alias("lang"), (text if text is not None else F.col("text")).alias("text"))


def first_word() -> Column:
    word = F.regexp_extract("text", tx.IDENT, 0)
    return F.when(word == "", F.lit("w0")).otherwise(word)


def flat_text() -> Column:
    return F.regexp_replace("text", r'[\n"\\]', " ")


def c_code() -> Column:
    """C-like code around the whole text: in comments, in a string, and plain."""
    w, flat = first_word(), flat_text()
    return F.concat(
        F.lit("int x;\n#include <"), F.col("source"), F.lit(">\nstruct "), w, F.lit("; enum "), w,
        F.lit("; a."), w, F.lit(" = p->"), w, F.lit(";\nf("), w, F.lit(");  // "), flat,
        F.lit(" \\\n cont "), w, F.lit("\n\n  /* "), F.col("text"), F.lit(" */ s = \""), flat,
        F.lit("\\\"\";\n#  include \"y.h\"\n"), F.col("text"))


def python_code() -> Column:
    """Python code around the whole text: in a docstring, a comment, a string, and plain."""
    w, flat = first_word(), flat_text()
    return F.concat(
        F.lit("import os\ndef "), w, F.lit("(a):\n    \"\"\""), F.col("text"),
        F.lit("\"\"\"\n    return x."), w, F.lit("  # "), flat, F.lit("\n    s = '"), flat,
        F.lit("\\''\n"), F.col("text"))


def code_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus with code around each text, in the style of its filetype."""
    return corpus(spark, sf, F.when(F.col("lang") == "fr", python_code()).otherwise(c_code()))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, path, filetype, text) from ``pages``; the filetype is the language part of the URL."""
    part = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1)
    return read(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.col("url").alias("path"),
        part.alias("filetype"), F.col("html").alias("text"))


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """(name, file, pattern, kind, lang): one row per word occurrence in ``benchmark``."""
    items = read(spark, sf, "benchmark")
    kind = F.expr("substring('guesmfdtvp', CAST(item_id div 4 % 10 + 1 AS int), 1)")
    lang = _choice(F.col("item_id") % 4, [(0, "C"), (1, "c++"), (2, "Python")], "Go")
    return items.select(
        F.explode(tx.words(tx.ascii_fold("text"))).alias("name"),
        F.concat(F.lit("bench"), F.col("item_id").cast("string")).alias("file"),
        kind.alias("kind"), lang.alias("lang"),
    ).select("name", "file", F.concat(F.lit("/^"), "name", F.lit("$/;\"")).alias("pattern"), "kind", "lang")


def special_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue plus a dotted name for each variable and member."""
    plain = catalogue(spark, sf)
    dotted = plain.filter(F.col("kind").isin("v", "m")).withColumn(
        "name", F.concat("name", F.lit("."), "kind"))
    return plain.unionByName(dotted)


def raw_tag_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Tag lines as found in files: per item two headers, an empty and two malformed lines."""
    good = catalogue(spark, sf).select(F.concat_ws(
        "\t", "name", "file", "pattern", "kind", F.concat(F.lit("language:"), "lang")).alias("value"))
    item = F.col("item_id").cast("string")
    other = read(spark, sf, "benchmark").select(F.explode(F.array(
        F.lit("!_TAG_FILE_FORMAT\t2\t/extended format/"),
        F.concat(F.lit("!_TAG_ITEM\t"), item, F.lit("\t/x/;\"\tf\tlanguage:C")),
        F.lit(""),
        F.concat(F.lit("short"), item, F.lit("\tbench"), item),
        F.concat(F.lit("nokind"), item, F.lit("\tbench"), item, F.lit("\t/^x$/;\"\tlanguage:C")),
        F.concat(F.lit("tabbed"), item, F.lit("\tbench"), item, F.lit("\t/^a\tb\tcd$/;\"\tv\tlanguage:Go\tline:1")),
    )).alias("value"))
    return good.unionByName(other)


def ignored_names(spark: SparkSession, sf: str) -> DataFrame:
    """Ignore list: the names of one and two letters, for two filetypes."""
    short = catalogue(spark, sf).filter(F.length("name") <= 2).select("name").distinct()
    return short.select(F.explode(F.array(F.lit("c"), F.lit("python"))).alias("filetype"), "name")


def restored_names(spark: SparkSession, sf: str) -> DataFrame:
    """Built-in names: those of three letters, for the two C filetypes."""
    short = catalogue(spark, sf).filter(F.length("name") == 3).select("name").distinct()
    group = F.explode(F.array(F.struct(F.lit("c").alias("filetype"), F.lit("cType").alias("group")),
                              F.struct(F.lit("cpp").alias("filetype"), F.lit("cppType").alias("group"))))
    return short.select(group.alias("g"), "name").select("g.filetype", "g.group", "name")


def registry_log(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, op, path, arg) from ``events``; errors are no registry changes."""
    op = _choice(F.col("event_type"), [("click", "add_project"), ("purchase", "remove_project"),
                                       ("view", "add_dir")], "remove_dir")
    base = F.concat(F.lit("/src"), (F.col("user_id") % 20).cast("string"))
    path = F.when(F.col("event_id") % 3 == 0, F.concat(base, F.lit("/en"))).otherwise(base)
    arg = F.when(F.col("event_type") == "click", (F.col("event_id") % 2).cast("string")).otherwise(
        F.concat(F.lit("/ext"), (F.col("event_id") % 4).cast("string")))
    return read(spark, sf, "events").filter("event_type <> 'error'").select(
        F.col("event_id").alias("seq"), op.alias("op"), path.alias("path"), arg.alias("arg"))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """(path, reg_seq, run, dir)."""
    return fold_registry(registry_log(spark, sf))


def projects(registry_rows: DataFrame) -> DataFrame:
    """(path, reg_seq, run), one row per project."""
    return registry_rows.select("path", "reg_seq", "run").distinct()


def as_editor_events(raw: DataFrame) -> DataFrame:
    """(event_id, ts, instance_id, buffer_id, event, fp) from rows like those of ``events``."""
    event = _choice(F.col("event_type"), [
        ("click", "BufReadPre"), ("view", "BufEnter"), ("purchase", "BufWritePost"),
        ("signup", "FileType")], "Toggle")
    return raw.select(
        "event_id", "ts", F.col("user_id").alias("instance_id"),
        (F.regexp_extract("props", "[0-9]+", 0).cast("int") % 8).alias("buffer_id"),
        event.alias("event"), F.floor(F.col("value") / 5).cast("bigint").alias("fp"))


def routed(raw: DataFrame, toggles: bool = False) -> DataFrame:
    """(event_id, ts, instance_id, buffer_id, action, forced, fp)."""
    actions = cfg.event_actions(raw.sparkSession, TOGGLE if toggles else None)
    return route(as_editor_events(raw), actions).select(
        "event_id", "ts", "instance_id", "buffer_id", "action", "forced", "fp")
