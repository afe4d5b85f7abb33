"""Tag lines, kinds, presence, groups and rendering on literal catalogues."""

import hashlib

from pyspark.sql import functions as F

from termindex import config as cfg
from termindex import rules as defaults
from termindex.operators import assign, catalogue as cat, match, render
from termindex.plans.inventory import Settings, build_matchers

LINES = [
    "!_TAG_FILE_FORMAT\t2\t/extended format/",
    'foo\tsrc/a.c\t/^int foo(\tvoid)$/;"\tf\tlanguage:C',
    'foo\tsrc/a.h\t/^int foo(void);$/;"\tp\tlanguage:C',
    'Node\tsrc/a.cpp\t/^struct Node {$/;"\ts\tlanguage:C++',
    'Node\tsrc/a.cpp\t/^typedef struct Node Node;$/;"\tt\tlanguage:C++',
    'helper\tsrc/b.py\t/^def helper():$/;"\tf\tlanguage:Python',
    'nokind\tsrc/a.c\t/^x$/;"\tlanguage:C',
    "short\tsrc/a.c",
    'a.b\tsrc/a.c\t/^x$/;"\tm\tlanguage:C',
    'späte\tsrc/a.c\t/^x$/;"\tv\tlanguage:C',
]


def tags_of(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    return cat.valid_tags(cat.parse_tags(lines))


def usable(spark, **more):
    return cat.applicable_tags(tags_of(spark), cfg.kind_priority(cfg.orders(spark)), cfg.equivalents(spark),
                               cfg.language_map(spark), **more)


def docs_of(spark, text="foo Node helper", filetype="c"):
    return spark.createDataFrame([(1, "src/a.c", filetype, text)], "doc_id long, path string, filetype string, text string")


def tokens(spark, names, filetype="c"):
    return spark.createDataFrame([(1, filetype, n) for n in names], "doc_id long, filetype string, name string")


def test_parse(spark, rows):
    found = rows(tags_of(spark).select("name", "kind", "lang"))
    assert ("foo", "f", "C") in found and ("foo", "p", "C") in found
    assert len(found) == 7 and not any(r[0] in ("nokind", "short") or r[0].startswith("!") for r in found)


def test_kinds_and_languages(spark, rows):
    found = rows(cat.distinct_tags(usable(spark)).filter("filetype = 'c'").select("kind", "name"))
    assert found == [("f", "foo"), ("m", "a.b"), ("s", "Node"), ("t", "Node")]
    ignored = cfg.ignored_names(spark, {"c": ["foo"]})
    assert ("f", "foo") not in rows(usable(spark, ignored=ignored).filter("filetype = 'c'").select("kind", "name"))


def test_presence(spark, rows):
    toks = tokens(spark, ["foo", "Node", "helper", "b"])
    assert rows(match.present_tags(toks, usable(spark)).select("kind", "name")) == [
        ("f", "foo"), ("s", "Node"), ("t", "Node")]
    same = match.present_or_same_file(tokens(spark, ["x"]), docs_of(spark), usable(spark))
    assert rows(same.select("kind", "name")) == [("f", "foo"), ("m", "a.b")]
    plain = cat.distinct_tags(usable(spark))
    special = match.present_or_special(toks, docs_of(spark), plain)
    assert ("m", "a.b") in rows(special.select("kind", "name"))


def test_own_symbols_are_made_distinct_in_parts_of_bounded_size(spark):
    same = match.present_or_same_file(tokens(spark, ["x"]), docs_of(spark), usable(spark))
    above, below = same._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM")[:2]
    assert "HashAggregate(keys=[doc_id" in above and "HashAggregate(keys=[doc_id" not in below


def test_priority(spark, rows):
    best = assign.resolve_priority(usable(spark), cfg.kind_priority(cfg.orders(spark)))
    assert ("s", "Node") in rows(best.filter("filetype = 'c'").select("kind", "name"))
    assert ("t", "Node") not in rows(best.filter("filetype = 'c'").select("kind", "name"))


def test_order_strings(spark, rows):
    prios = rows(cfg.kind_priority(cfg.orders(spark, {"c": "guesmfdtv", "x": ""})))
    assert prios == [("c", k, i) for i, k in sorted(enumerate("guesmfdtv"), key=lambda p: p[1])]


def test_rules_and_overlay(spark):
    user = cfg.group_rules(spark, [("c", "f", "mine", None, None, ["A.*"], None), ("new", "x", "g", None, None, None, 0)])
    rules = {(r["filetype"], r["kind"]): r for r in cfg.overlay_rules(cfg.group_rules(spark), user).collect()}
    assert rules["c", "f"]["group"] == "mine" and rules["c", "s"]["group"] == "cStructTag"
    assert rules["new", "x"]["allow_keyword"] == 0
    merged = {(r["filetype"], r["kind"]): r["notin"] for r in render.merge_exclusions(
        cfg.overlay_rules(cfg.group_rules(spark), user)).collect()}
    assert merged["c", "f"] == ["A.*", *defaults.GLOBAL_NOTIN] and not merged["c", "s"]


def test_links(spark):
    links = {r["src"]: r["dst"] for r in assign.resolve_links(cfg.group_links(spark)).collect()}
    assert links["cClassTag"] == "Type" and links["haxeVariableTag"] == "Identifier"
    assert len(links) == len(defaults.GROUP_LINKS)
    chain = cfg.group_links(spark, [(f"g{i}", f"g{i + 1}") for i in range(8)])
    assert {r["src"]: r["dst"] for r in assign.resolve_links(chain).collect()}["g0"] == "g8"
    for n in (12, 1000):
        long = spark.createDataFrame([(f"g{i}", f"g{i + 1}") for i in range(n)] + [("x", "y"), ("y", "z"), ("z", "y"), ("q", "q")],
                                     "src string, dst string")
        assert {r["src"]: r["dst"] for r in assign.resolve_links(long).collect()} == {f"g{i}": f"g{n}" for i in range(n)}


def test_builtins_win(spark, rows):
    assigned = spark.createDataFrame([("c", "f", "if", "F"), ("c", "f", "g", "F"), ("go", "f", "if", "F")],
                                     "filetype string, kind string, name string, group string")
    restored = spark.createDataFrame([("c", "cConditional", "if")], "filetype string, group string, name string")
    assert rows(assign.restore_builtins(assigned, restored).select("filetype", "name", "group")) == [
        ("c", "g", "F"), ("c", "if", "cConditional"), ("go", "if", "F")]


def test_forms(spark):
    rows = [("c", "e", "cEnumTag", 0, "plain"), ("c", "d", "cPreProcTag", 0, "dotted.name"),
            ("c", "t", "cTypeTag", 0, "suffixed"), ("haxe", "v", "haxeVariableTag", 0, "nokeyword"),
            ("go", "f", "mine", 0, "excluding"), ("c", "e", "cType", 0, "builtin")]
    chunks = spark.createDataFrame(rows, "filetype string, kind string, group string, chunk long, name string")
    rules = cfg.overlay_rules(cfg.group_rules(spark), cfg.group_rules(
        spark, [("go", "f", "mine", None, None, ["J.*"], None)]))
    out = {r["group"]: r for r in render.render(chunks, rules, escape=True).collect()}
    assert {g: r["form"] for g, r in out.items()} == {
        "cEnumTag": "keyword", "cPreProcTag": "match", "cTypeTag": "match",
        "haxeVariableTag": "match", "mine": "excluding", "cType": "keyword"}
    assert out["cPreProcTag"]["text"] == r"\C\<dotted\.name\>"
    assert out["cPreProcTag"]["fingerprint"] == hashlib.md5(b"dotted.name").hexdigest()
    assert out["mine"]["excluded"] == "J.*" and out["cEnumTag"]["text"] == "plain"


def test_empty_groups(spark, rows):
    tags = spark.createDataFrame([("c", "f", "a"), ("c", "f", "b")], "filetype string, kind string, name string")
    found = rows(assign.with_empty_groups(tags, cfg.kind_priority(cfg.orders(spark, {"c": "gf"}))))
    assert found == [("c", "f", 1, 2), ("c", "g", 0, 0)]


def test_whole_chain(spark):
    corpus = docs_of(spark, "struct Node n; /* foo */ x = foo2;")
    settings = Settings.default(spark)
    out = build_matchers(corpus, tags_of(spark), settings).collect()
    assert [(r["kind"], r["group"], r["n"], r["text"]) for r in out] == [
        ("s", "cStructTag", 1, r"\%(struct\s\+\)\@7<=Node\>")]
    settings.strip = False
    assert {r["kind"] for r in build_matchers(corpus, tags_of(spark), settings).collect()} == {"s", "f"}
    none = build_matchers(docs_of(spark, "foo", "markdown"), tags_of(spark), settings)
    assert none.count() == 0


def test_compound_filetypes(spark, rows):
    from termindex.plans.inventory import present_symbols
    found = present_symbols(docs_of(spark, "x = foo; // Node\n Node", "C.doxygen"), tags_of(spark), Settings.default(spark))
    assert rows(found.select("filetype", "kind", "name")) == [("c", "f", "foo"), ("c", "s", "Node")]
    # The first part picks the tags, each part its own kinds: in a "python.go"
    # document the Python function is a kind of both orders.
    two = docs_of(spark, "helper", "python.go")
    found = present_symbols(two, tags_of(spark), Settings.default(spark))
    assert rows(found.select("filetype", "kind", "name")) == [("go", "f", "helper"), ("python", "f", "helper")]
    both = docs_of(spark, "foo helper", "c").union(docs_of(spark, "foo helper", "go.c")).union(two)
    found = present_symbols(both, tags_of(spark), Settings.default(spark))
    assert rows(found.select("filetype", "kind", "name")) == [
        ("c", "f", "foo"), ("go", "f", "helper"), ("python", "f", "helper")]


def test_languages(spark, rows):
    df = spark.createDataFrame([("CPP",), ("objc",), ("nope",)], "filetype string")
    assert rows(cat.identify_language(df, cfg.languages(spark))) == [
        ("CPP", "cpp"), ("nope", "unknown"), ("objc", "c")]
    several = cfg.language_map(spark, [("C++", "cpp"), ("JavaScript", "flow"), ("JavaScript", "jsx")])
    ft = spark.createDataFrame([("flow",), ("jsx",), ("rust",)], "filetype string")
    assert rows(cat.normalize_language(ft, several)) == [("flow", "JavaScript"), ("jsx", "JavaScript"), ("rust", "rust")]
    parts = spark.createDataFrame([("A.b",)], "filetype string")
    assert rows(cat.split_filetype(parts).select("part_no", "part")) == [(0, "a"), (1, "b")]
    assert cat.drop_ignored_filetypes(spark.createDataFrame([("",), ("text",), ("c",)], "filetype string")).count() == 1
    assert tags_of(spark).filter(F.col("lang") == "C++").count() == 2


def test_chain_options(spark):
    tags = spark.createDataFrame(
        [("s:foo", "a.vim", "f", "Vim"), ("bar", "own.vim", "f", "Vim"), ("g:x.y", "a.vim", "v", "Vim"), ("s:gone", "a.vim", "f", "Vim")],
        "name string, file string, kind string, lang string")
    corpus = spark.createDataFrame([(1, "own.vim", "vim", "call s:foo() now")], "doc_id long, path string, filetype string, text string")
    settings = Settings.default(spark)

    def names():
        return {w for r in build_matchers(corpus, tags, settings).collect() for w in r["text"].split("=")[-1].removesuffix(r"\>").split("|")}

    assert names() == {"foo"}
    settings.same_file = True
    assert names() == {"foo", "bar"}
    settings.same_file, settings.special = False, True
    assert {r["kind"] for r in build_matchers(corpus, tags, settings).collect()} == {"f", "v"}
