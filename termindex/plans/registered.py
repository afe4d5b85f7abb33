"""Every operator as a query over the test tables: name -> (spark, folder) -> DataFrame.

Results are flat and free of arrays, so they can be compared with SQL results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex import config as cfg
from termindex import rules as defaults
from termindex.functions import keys
from termindex.functions import text as tx
from termindex.operators import assign, corpus as docs, extract, match, projects, render, spans
from termindex.operators import catalogue as cat
from termindex.plans import bindings as b
from termindex.plans.inventory import Settings, build_matchers
from termindex.session import new_folder
from termindex.sources import corpus as corpus_source
from termindex.sources import registry as registry_source
from termindex.sources import tagfiles
from termindex.streaming import events as ev
from termindex.streaming import state as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- shared pieces -----------------------------------------------------------

def _priorities(spark: SparkSession) -> DataFrame:
    return cfg.kind_priority(cfg.orders(spark))


def _usable(spark: SparkSession, tags: DataFrame) -> DataFrame:
    return cat.applicable_tags(tags, _priorities(spark), cfg.equivalents(spark), cfg.language_map(spark))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return docs.tokenize(docs.spread(b.corpus(spark, sf)))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """(filetype, kind, name, prio) of symbols present in the corpus, all their kinds."""
    usable = _usable(spark, b.catalogue(spark, sf)).select("filetype", "kind", "name", "prio").distinct()
    return match.present_in_corpus(_tokens(spark, sf), usable)


def _best(spark: SparkSession, sf: str) -> DataFrame:
    return assign.resolve_priority(_hits(spark, sf), _priorities(spark))


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    return assign.apply_rules(_best(spark, sf), cfg.group_rules(spark)).select(
        "filetype", "kind", "group", "name")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return docs.spread(b.pages(spark, sf))


def _code(spark: SparkSession, sf: str, python: bool) -> DataFrame:
    made = b.python_code() if python else b.c_code()
    return b.corpus(spark, sf, made)


# --- sources and sinks -------------------------------------------------------

@query
def scan_tags_plain(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "tags-plain")
    tagfiles.write_tags(b.raw_tag_lines(spark, sf), folder, "none", by=())
    return tagfiles.read_tags(spark, folder)


@query
def scan_tags_gzip(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "tags-gzip")
    tagfiles.write_tags(b.raw_tag_lines(spark, sf), folder, "gzip", by=())
    return tagfiles.read_tags(spark, folder, spark.sparkContext.defaultParallelism)


@query
def scan_tags_xz(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "tags-xz")
    tagfiles.write_tags(b.raw_tag_lines(spark, sf), folder, "lzma", by=())
    return tagfiles.read_tags_xz(spark, folder)


@query
def scan_tags_manifest(spark: SparkSession, sf: str) -> DataFrame:
    lines = b.raw_tag_lines(spark, sf)
    folder = new_folder(spark, "tags-mixed")
    listed = []
    for codec in tagfiles.CODECS:
        tagfiles.write_tags(lines, f"{folder}/{codec}", codec, by=())
        listed.append((f"{folder}/{codec}", codec))
    listed += [(f"{folder}/missing", "gzip"), (f"{folder}/none", "zip")]
    return tagfiles.read_tag_manifest(spark, cfg.table(spark, "path string, codec string", listed))


@query
def scan_corpus(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "corpus")
    corpus_source.write_corpus(docs.spread(b.read(spark, sf, "documents").select("doc_id", "text")), folder, "doc_id", "text")
    found = corpus_source.read_corpus(spark, folder)
    return found.select(
        F.regexp_extract("path", r"doc_id=([0-9]+)\.", 1).cast("bigint").alias("doc_id"), "ext", "text")


@query
def scan_registry_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.registry(spark, sf).groupBy("path", "run").agg(F.array_sort(F.collect_set("dir")).alias("extra_dirs"))
    entry = F.to_json(F.create_map("path", F.struct("run", "extra_dirs")))
    folder = new_folder(spark, "registry")
    rows.select(F.explode(F.array(entry, F.lit("{broken"), F.lit(""))).alias("value")).write.text(folder)
    return registry_source.read_registry(spark, folder, one_per_line=True).select(
        "path", "run", F.array_join("extra_dirs", ",").alias("dirs"))


@query
def sink_tags_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    tags = b.catalogue(spark, sf)
    rooted = tags.select("*", keys.root_key(F.concat(F.lit("/src/"), "file")).alias("root_key"),
                         F.lower("lang").alias("filetype"))
    folder = new_folder(spark, "tags-by-root")
    tagfiles.write_tags(tagfiles.tag_lines(rooted), folder, "gzip")
    return tagfiles.read_tags(spark, folder).select("root_key", "filetype", "value")


# --- symbol extraction -------------------------------------------------------

@query
def extract_symbols(spark: SparkSession, sf: str) -> DataFrame:
    corpus = docs.spread(b.corpus(spark, sf))
    return extract.extract_symbols(corpus, [*defaults.LINE_RULES, *b.LINE_RULES])


@query
def select_sources_by_ext(spark: SparkSession, sf: str) -> DataFrame:
    files = b.corpus(spark, sf).select("doc_id", "path", "filetype")
    return extract.filter_ext(files, cfg.extensions(spark))


@query
def exclude_sources_glob(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("doc_id") % 8
    number = F.col("doc_id").cast("string")
    name = (F.when(turn == 0, F.concat(F.lit("doc"), number, F.lit("/Makefile")))
            .when(turn == 1, F.concat(F.lit("a"), number, F.lit("config.log")))
            .when(turn == 2, F.concat(F.lit(".mypy_cache/"), number, F.lit(".json")))
            .when(turn == 3, F.concat(F.lit("configure"), number))
            .otherwise(F.concat(F.lit("doc"), number, F.lit(".c"))))
    files = b.read(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"))
    return extract.exclude_globs(files)


def _owned_files(spark: SparkSession, sf: str) -> DataFrame:
    files = b.corpus(spark, sf).select("doc_id", "path")
    return projects.with_project(files, b.projects(b.registry(spark, sf)))


@query
def scan_unit(spark: SparkSession, sf: str) -> DataFrame:
    return extract.scan_unit(_owned_files(spark, sf), b.NORECURSE).select("doc_id", "path", "unit")


@query
def stale_units(spark: SparkSession, sf: str) -> DataFrame:
    registry = b.projects(b.registry(spark, sf))
    units = extract.scan_unit(_owned_files(spark, sf), b.NORECURSE).select("unit").distinct()
    flagged = units.join(registry.select(F.col("path").alias("unit"), "run"), "unit", "left")
    manifest = b.read(spark, sf, "documents").groupBy(
        F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("unit")).agg(
        F.when(F.count(F.lit(1)) >= 8, F.sum("n_chars")).otherwise(F.lit(0)).alias("size"))
    return extract.units_to_index(flagged, manifest)


# --- parsing and projections -------------------------------------------------

@query
def parse_tag_lines(spark: SparkSession, sf: str) -> DataFrame:
    return cat.parse_tags(b.raw_tag_lines(spark, sf))


@query
def ascii_fold(spark: SparkSession, sf: str) -> DataFrame:
    return b.read(spark, sf, "documents").select("doc_id", tx.ascii_fold("text").alias("text"))


@query
def strip_clike(spark: SparkSession, sf: str) -> DataFrame:
    return _code(spark, sf, False).select("doc_id", tx.strip_clike("text").alias("text"))


@query
def strip_python(spark: SparkSession, sf: str) -> DataFrame:
    return _code(spark, sf, True).select("doc_id", tx.strip_python("text").alias("text"))


@query
def strip_includes(spark: SparkSession, sf: str) -> DataFrame:
    return _code(spark, sf, False).select(
        "doc_id", tx.strip_includes(tx.strip_clike("text")).alias("text"))


@query
def squeeze_blank(spark: SparkSession, sf: str) -> DataFrame:
    return _code(spark, sf, True).select("doc_id", tx.squeeze_blank(tx.ascii_fold("text")).alias("text"))


@query
def strip_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    corpus = b.code_corpus(spark, sf)
    # One filetype in four has no comment family here: its text must stay.
    families = cfg.comment_families(spark).filter("language <> 'go'")
    cleaned = docs.clean_corpus(corpus, cfg.languages(spark), families)
    return cleaned.select("doc_id", "filetype", "text")


@query
def normalize_language(spark: SparkSession, sf: str) -> DataFrame:
    named = cat.normalize_language(b.corpus(spark, sf).select("doc_id", "filetype"), cfg.language_map(spark))
    tags = cat.filetype_of_language(b.catalogue(spark, sf).select("lang").distinct(), cfg.language_map(spark))
    counted = named.groupBy("filetype", "language").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(tags.groupBy("filetype", F.col("lang").alias("language")).agg(
        F.count(F.lit(1)).alias("n")))


@query
def identify_language(spark: SparkSession, sf: str) -> DataFrame:
    odd = b.pages(spark, sf).select("doc_id", F.upper("filetype").alias("filetype"))
    known = b.corpus(spark, sf).select("doc_id", F.upper("filetype").alias("filetype"))
    return cat.identify_language(known.unionByName(odd), cfg.languages(spark))


@query
def split_filetype(spark: SparkSession, sf: str) -> DataFrame:
    compound = b.corpus(spark, sf).select(
        "doc_id", F.concat_ws(".", F.upper("filetype"), F.element_at(F.split("path", "/"), 2)).alias("filetype"))
    return cat.split_filetype(compound)


@query
def remap_kind(spark: SparkSession, sf: str) -> DataFrame:
    tags = cat.match_language(b.catalogue(spark, sf), _priorities(spark), cfg.language_map(spark))
    return cat.remap_kind(tags, cfg.equivalents(spark)).select("filetype", "kind", "name", "file")


@query
def kind_priority(spark: SparkSession, sf: str) -> DataFrame:
    tags = cat.match_language(b.catalogue(spark, sf), _priorities(spark), cfg.language_map(spark))
    return (tags.groupBy("filetype", "kind").agg(F.count(F.lit(1)).alias("n"))
            .join(_priorities(spark), ["filetype", "kind"]))


@query
def root_key(spark: SparkSession, sf: str) -> DataFrame:
    files = b.corpus(spark, sf).select("doc_id", extract.directory("path").alias("dir"), "filetype")
    return files.select("doc_id", keys.root_key("dir").alias("root_key"),
                        keys.root_key("dir", F.col("filetype")).alias("typed_key"))


@query
def scope_local_name(spark: SparkSession, sf: str) -> DataFrame:
    tags = b.catalogue(spark, sf).select(
        "file", "kind", F.concat(F.substring("lang", 1, 1), F.lit(":"), "name", F.lit(":"), "kind").alias("scoped"))
    return tags.select("file", "kind", "scoped", keys.local_name("scoped", "kind").alias("name"))


@query
def group_key(spark: SparkSession, sf: str) -> DataFrame:
    tags = _usable(spark, b.catalogue(spark, sf)).select("filetype", "kind").distinct()
    grouped = assign.apply_rules(tags, cfg.group_rules(spark))
    return grouped.select("filetype", "kind", keys.group_key("filetype", "kind").alias("key"),
                          keys.output_key("filetype", "kind", "group").alias("out_key"))


# --- tokens ------------------------------------------------------------------

@query
def tokenize_ident(spark: SparkSession, sf: str) -> DataFrame:
    return docs.token_counts(docs.spread(b.corpus(spark, sf)), "ident")


@query
def tokenize_word(spark: SparkSession, sf: str) -> DataFrame:
    return docs.token_counts(_pages(spark, sf).withColumn("text", tx.ascii_fold("text")), "word")


@query
def tokenize_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return docs.token_counts(_pages(spark, sf), "scoped")


@query
def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return spans.occurrences(docs.spread(b.corpus(spark, sf)))


# --- filters -----------------------------------------------------------------

@query
def filter_ignored_filetypes(spark: SparkSession, sf: str) -> DataFrame:
    corpus = b.corpus(spark, sf).select("doc_id", "path", "filetype").withColumn(
        "filetype", F.when(F.length("path") <= 17, F.lit("markdown"))
        .when(F.length("path") == 18, F.lit("")).otherwise(F.col("filetype"))).drop("path")
    return cat.drop_ignored_filetypes(corpus)


@query
def filter_malformed_tags(spark: SparkSession, sf: str) -> DataFrame:
    return cat.valid_tags(cat.parse_tags(b.raw_tag_lines(spark, sf)))


@query
def filter_kind_in_order(spark: SparkSession, sf: str) -> DataFrame:
    tags = cat.match_language(b.catalogue(spark, sf), _priorities(spark), cfg.language_map(spark))
    return cat.in_order(tags, _priorities(spark)).select("filetype", "kind", "name", "prio")


@query
def filter_language(spark: SparkSession, sf: str) -> DataFrame:
    tags = cat.match_language(b.catalogue(spark, sf), _priorities(spark), cfg.language_map(spark))
    return tags.select("filetype", "lang", "kind", "name")


@query
def filter_ignored_tags(spark: SparkSession, sf: str) -> DataFrame:
    usable = _usable(spark, b.catalogue(spark, sf))
    return cat.drop_ignored_tags(usable, b.ignored_names(spark, sf)).select("filetype", "kind", "name")


@query
def keep_special_names(spark: SparkSession, sf: str) -> DataFrame:
    tags = cat.distinct_tags(_usable(spark, b.special_catalogue(spark, sf)))
    return match.present_or_special(_tokens(spark, sf), b.corpus(spark, sf), tags).select(
        "filetype", "kind", "name")


# --- joins -------------------------------------------------------------------

@query
def present_tags(spark: SparkSession, sf: str) -> DataFrame:
    return match.present_tags(_tokens(spark, sf), _usable(spark, b.catalogue(spark, sf)))


@query
def present_or_same_file(spark: SparkSession, sf: str) -> DataFrame:
    corpus = b.corpus(spark, sf)
    own = corpus.select(F.concat(F.lit("sym_"), F.col("doc_id").cast("string")).alias("name"),
                        F.col("path").alias("file"), F.lit("").alias("pattern"), F.lit("f").alias("kind"), "lang")
    tags = _usable(spark, cat.union_tags(b.catalogue(spark, sf), own))
    return match.present_or_same_file(_tokens(spark, sf), corpus, tags)


@query
def resolve_project(spark: SparkSession, sf: str) -> DataFrame:
    return projects.resolve_project(b.corpus(spark, sf), b.projects(b.registry(spark, sf)))


@query
def expand_roots(spark: SparkSession, sf: str) -> DataFrame:
    return projects.project_roots(b.registry(spark, sf))


@query
def apply_rules(spark: SparkSession, sf: str) -> DataFrame:
    return assign.apply_rules(_hits(spark, sf), cfg.group_rules(spark)).select(
        "filetype", "kind", "name", F.col("group").alias("grp"), "prefix", "suffix", "allow_keyword")


@query
def resolve_group_links(spark: SparkSession, sf: str) -> DataFrame:
    links = assign.resolve_links(cfg.group_links(spark))
    return (_grouped(spark, sf).groupBy("group").agg(F.count(F.lit(1)).alias("n"))
            .join(links, F.col("group") == F.col("src"))
            .select(F.col("src"), F.col("dst"), "n"))


@query
def restore_builtin_groups(spark: SparkSession, sf: str) -> DataFrame:
    return assign.restore_builtins(_grouped(spark, sf), b.restored_names(spark, sf)).select(
        "filetype", "kind", "name", F.col("group").alias("grp"))


@query
def mask_regions(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf)
    return spans.mask_regions(spans.occurrences(pages), spans.region_spans(pages, "markup"))


@query
def mask_regions_inline(spark: SparkSession, sf: str) -> DataFrame:
    return spans.occurrences_outside(_pages(spark, sf), "markup")


@query
def region_spans(spark: SparkSession, sf: str) -> DataFrame:
    marked = spans.region_spans(_pages(spark, sf), "markup").withColumn("family", F.lit("markup"))
    coded = spans.region_spans(_code(spark, sf, False), "clike").withColumn("family", F.lit("clike"))
    scripted = spans.region_spans(_code(spark, sf, True), "python").withColumn("family", F.lit("python"))
    return marked.unionByName(coded).unionByName(scripted)


@query
def context_match(spark: SparkSession, sf: str) -> DataFrame:
    corpus = b.code_corpus(spark, sf)
    best = assign.resolve_priority(_usable(spark, b.catalogue(spark, sf)), _priorities(spark))
    known = match.settled(best.select("filetype", "name", "kind"))
    placed = spans.occurrences(corpus, ["filetype"], context=True, names=spans.with_keywords(known))
    kinds = match.lookup(placed, known, ["filetype", "name"], salt_by=F.col("doc_id"))
    return spans.context_match(kinds).groupBy("doc_id", "filetype", "kind", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"), F.sum("end").alias("sum_end"))


# --- aggregations ------------------------------------------------------------

@query
def distinct_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf)


@query
def distinct_tags(spark: SparkSession, sf: str) -> DataFrame:
    return cat.distinct_tags(_usable(spark, b.catalogue(spark, sf)))


@query
def group_members(spark: SparkSession, sf: str) -> DataFrame:
    return assign.group_members(_best(spark, sf), b.CHUNK).select(
        "filetype", "kind", "chunk", F.array_join("members", ",").alias("members"))


@query
def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    return assign.group_counts(_hits(spark, sf))


@query
def empty_groups(spark: SparkSession, sf: str) -> DataFrame:
    return assign.with_empty_groups(_hits(spark, sf), _priorities(spark))


@query
def group_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return render.group_fingerprint(_best(spark, sf), ["filetype", "kind"], b.CHUNK)


@query
def fingerprint_tree(spark: SparkSession, sf: str) -> DataFrame:
    return render.fingerprint_tree(_best(spark, sf), ["filetype", "kind"], b.CHUNK)


# --- ranks and chunks --------------------------------------------------------

@query
def priority_kind(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf)


@query
def chunk_members(spark: SparkSession, sf: str) -> DataFrame:
    return render.chunk(_best(spark, sf).select("filetype", "kind", "name"), ["filetype", "kind"], b.CHUNK)


@query
def sort_tags_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return render.sort_tags_by_name(b.catalogue(spark, sf))


@query
def sort_tags_kind_len(spark: SparkSession, sf: str) -> DataFrame:
    return render.sort_tags_by_kind_and_length(b.catalogue(spark, sf))


@query
def order_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    counts = _hits(spark, sf).groupBy("filetype", "kind").agg(F.count(F.lit(1)).alias("n"))
    return render.order_groups(counts, _priorities(spark))


# --- sets --------------------------------------------------------------------

@query
def union_tag_sets(spark: SparkSession, sf: str) -> DataFrame:
    tags = b.catalogue(spark, sf).drop("pattern")
    found = extract.extract_symbols(docs.spread(b.corpus(spark, sf)), b.LINE_RULES).drop("line_no")
    return cat.union_tags(tags, found, tags)


@query
def merge_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    rules = cfg.overlay_rules(cfg.group_rules(spark), cfg.group_rules(spark, b.USER_RULES))
    merged = assign.apply_rules(_hits(spark, sf), render.merge_exclusions(rules))
    return merged.groupBy("filetype", "kind", F.array_join("notin", ",").alias("excluded")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def registry_fold(spark: SparkSession, sf: str) -> DataFrame:
    return b.registry(spark, sf)


# --- rendering ---------------------------------------------------------------

def _rendered(spark: SparkSession, sf: str, escape: bool = False) -> DataFrame:
    rules = cfg.overlay_rules(cfg.group_rules(spark), cfg.group_rules(spark, b.USER_RULES))
    rules = render.merge_exclusions(rules)
    tags = _usable(spark, b.special_catalogue(spark, sf)).select("filetype", "kind", "name", "prio").distinct()
    present = match.present_or_special(_tokens(spark, sf), b.corpus(spark, sf), tags)
    best = assign.resolve_priority(present, _priorities(spark))
    grouped = assign.apply_rules(best, rules).select("filetype", "kind", "group", "name")
    return render.render(render.chunk(grouped, ["filetype", "kind", "group"], b.CHUNK), rules, escape=escape)


@query
def matcher_form(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf).select("filetype", "kind", F.col("group").alias("grp"), "chunk", "form", "n")


@query
def render_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf).select("filetype", "kind", "chunk", "text", "excluded", "fingerprint")


@query
def escape_names(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf, escape=True).select("filetype", "kind", "chunk", "text")


@query
def matcher_inventory(spark: SparkSession, sf: str) -> DataFrame:
    settings = Settings.default(spark)
    settings.ignored = b.ignored_names(spark, sf)
    settings.restored = b.restored_names(spark, sf)
    settings.chunk_size = b.CHUNK
    return build_matchers(b.code_corpus(spark, sf), b.catalogue(spark, sf), settings).withColumnRenamed(
        "group", "grp")


# --- streaming ---------------------------------------------------------------

def _routed(spark: SparkSession, sf: str, toggles: bool = False) -> DataFrame:
    return b.routed(b.read(spark, sf, "events"), toggles)


def _stream(spark: SparkSession, sf: str, toggles: bool = False) -> DataFrame:
    return b.routed(ev.read_events(spark, sf, b.EVENT_SCHEMA, "events.parquet"), toggles)


EMITTED = ["event_id", "instance_id", "buffer_id", "fp"]


@query
def route_events(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf, toggles=True).select("event_id", "action", "forced")


@query
def route_events_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = st.run_to_table(_stream(spark, sf, toggles=True).select("event_id", "action", "forced"), "routed")
    return spark.read.parquet(out)


@query
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return ev.first_seen(_routed(spark, sf))


@query
def first_seen_stream(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(st.run_to_table(ev.first_seen(_stream(spark, sf)), "seen"))


@query
def emit_on_change(spark: SparkSession, sf: str) -> DataFrame:
    return ev.emit_on_change(_routed(spark, sf)).select(*EMITTED)


@query
def emit_on_change_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = st.run_to_table(st.emit_on_change_stream(_stream(spark, sf)), "changed")
    return spark.read.parquet(out).select(*EMITTED)


@query
def emit_on_change_by_batch(spark: SparkSession, sf: str) -> DataFrame:
    out = new_folder(spark, "changed")
    st.run_steps(_stream(spark, sf), st.emit_per_batch(out, new_folder(spark, "changed-state")), "changed")
    return spark.read.parquet(out).select(*EMITTED)


@query
def enabled_gate(spark: SparkSession, sf: str) -> DataFrame:
    return ev.enabled_gate(_routed(spark, sf, toggles=True)).select(*EMITTED, "epoch")


@query
def enabled_gate_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = st.run_to_table(st.enabled_gate_stream(_stream(spark, sf, toggles=True)), "gated")
    return spark.read.parquet(out).select(*EMITTED, "epoch")


@query
def enabled_gate_by_batch(spark: SparkSession, sf: str) -> DataFrame:
    out = new_folder(spark, "gated")
    st.run_steps(_stream(spark, sf, toggles=True),
                 st.gate_per_batch(out, new_folder(spark, "gated-state")), "gated")
    return spark.read.parquet(out).select(*EMITTED, "epoch")


def _hourly(events: DataFrame) -> DataFrame:
    return events.withColumn("slice", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH"))


@query
def latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return ev.latest_wins(_hourly(_routed(spark, sf)), ["slice"]).select("slice", *EMITTED)


@query
def latest_wins_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = new_folder(spark, "latest")
    st.run_steps(_hourly(_stream(spark, sf)), st.latest_per_batch(out, ["slice"]), "latest")
    return spark.read.parquet(out).select("slice", *EMITTED)


@query
def incremental_index(spark: SparkSession, sf: str) -> DataFrame:
    units = b.corpus(spark, sf).withColumn(
        "root_key", keys.root_key(F.concat(F.lit("/"), F.element_at(F.split("path", "/"), 2))))
    touched = _stream(spark, sf).select(
        keys.root_key(F.concat(F.lit("/src"), (F.col("instance_id") % 20).cast("string"))).alias("root_key"),
        "forced")

    def extract_units(part: DataFrame) -> DataFrame:
        return extract.extract_symbols(docs.spread(part), b.LINE_RULES, keep=["root_key"])

    out = new_folder(spark, "index")
    st.run_steps(touched, st.reindex_per_batch(units, extract_units, out), "index")
    return st.read_index(spark, out).select("root_key", "name", "file", "kind", "lang", "line_no")


# --- extension by data -------------------------------------------------------

@query
def custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = cfg.overlay_rules(cfg.group_rules(spark), cfg.group_rules(spark, b.USER_RULES))
    orders = cfg.overlay_orders(cfg.orders(spark), cfg.orders(spark, b.USER_ORDERS))
    same = cfg.overlay_equivalents(cfg.equivalents(spark), cfg.equivalents(spark, {"go": {"e": "f"}}))
    usable = cat.applicable_tags(b.catalogue(spark, sf), cfg.kind_priority(orders), same, cfg.language_map(spark))
    return assign.apply_rules(usable, rules).groupBy(
        "filetype", "kind", F.col("group").alias("grp"), "prefix", "suffix", "allow_keyword", "prio").agg(
        F.count(F.lit(1)).alias("n"))


@query
def custom_extractors(spark: SparkSession, sf: str) -> DataFrame:
    lines = b.read(spark, sf, "conversations")
    corpus = docs.spread(lines).select(
        F.concat(F.lit("/conv"), F.col("conv_id").cast("string"), F.lit("/"),
                 F.col("turn").cast("string")).alias("path"),
        F.when(F.col("role") == "user", "C").otherwise("Python").alias("lang"), "text")
    return extract.extract_symbols(corpus, [*defaults.LINE_RULES, *b.LINE_RULES, *b.EXTRA_LINE_RULES])
