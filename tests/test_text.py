"""Literal cases of cleaning, tokenising and positions."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termindex.functions import keys, pieces
from termindex.functions import text as tx
from termindex.operators import corpus as docs
from termindex.operators import spans


def run(spark, expression, value):
    return spark.createDataFrame([(value,)], "t string").select(expression("t").alias("o")).first()[0]


CLIKE = [
    ("a/*x*/b", "ab"),
    ("a/*/b*/c", "ac"),
    ("x//\ny\n", "x\ny\n"),
    ("m // c \\\n cont\nz", "m \nz"),
    ("p // end", "p "),
    ("q /* open", "q /* open"),
    ('L"s"R', "LR"),
    ('r "unterm\nnext', "r \nnext"),
    ("t 'un", "t 'un"),
    ('"a\\"b" c', " c"),
    ("'\\'' d // 'x\n'y' e", " d \n e"),
]
PYTHON = [
    ("a # c\nb", "a \nb"),
    ('d = """x\n"q" # z""" e', "d =  e"),
    ('h = "a\\"b" i', "h =  i"),
    ('j = "#no" k', "j =  k"),
    ("'''a'b''' c", " c"),
]
FOLD = [("é😀a", "??a"), ("plain", "plain")]
SQUEEZE = [("a \n\n  b", "a \nb"), ("a\t  b", "a\tb"), ("  a", " a"), ("x\n \n y", "x\ny")]


@pytest.mark.parametrize("value,expected", CLIKE)
def test_strip_clike(spark, value, expected):
    assert run(spark, tx.strip_clike, value) == expected


@pytest.mark.parametrize("value,expected", PYTHON)
def test_strip_python(spark, value, expected):
    assert run(spark, tx.strip_python, value) == expected


@pytest.mark.parametrize("value,expected", FOLD)
def test_fold(spark, value, expected):
    assert run(spark, tx.ascii_fold, value) == expected


@pytest.mark.parametrize("value,expected", SQUEEZE)
def test_squeeze(spark, value, expected):
    assert run(spark, tx.squeeze_blank, value) == expected


def test_includes(spark):
    value = "#include <a>\n#include <b>\n  # include <c>\nint x;\n"
    assert run(spark, tx.strip_includes, value) == "#include <a>\nint x;\n"


def test_stripping_folds_first(spark):
    assert run(spark, tx.strip_clike, 'é "日本 // 語" 😀 /* ж */ z') == "?  ?  z"
    assert run(spark, tx.strip_python, "é '日' 😀 # ж") == "?  ? "


def test_long_literals_do_not_overflow_the_stack(spark):
    value = "'" + "\\a" * 300_000 + "' x //" + "\\\n" * 300_000 + "\ny /*" + "*" * 300_000 + "*/"
    assert run(spark, tx.strip_clike, value) == " x \ny "


@pytest.mark.parametrize("mode,value,expected", [
    ("ident", "123abc x9 _y", ["abc", "x9", "_y"]),
    ("word", "123abc x9", ["123abc", "x9"]),
    ("scoped", "s:foo bar", ["s:foo", "foo", "bar"]),
    ("ident", "", []),
    ("ident", "last", ["last"]),
])
def test_tokens(spark, mode, value, expected):
    assert run(spark, lambda c: tx.words(c, mode), value) == expected


def test_escape_and_keys(spark):
    assert run(spark, tx.escape_name, "a.b*[c]~/\\^$") == "a\\.b\\*\\[c\\]\\~\\/\\\\\\^\\$"
    assert run(spark, lambda c: keys.root_key(c, F.lit("go")), "/a/b") == "__a__b_go"
    assert run(spark, lambda c: keys.local_name(c, F.lit("f")), "s:foo:x") == "foo:x"
    assert run(spark, lambda c: keys.local_name(c, F.lit("v")), "s:foo") == "s:foo"
    assert run(spark, lambda c: keys.output_key(F.lit("c"), F.lit("f"), c), "G") == "c_f_G"


def test_tiling_covers_every_text(spark):
    texts = ["", "a", "1", "ab 12 cd_3", " x" * 5000, "é" * 10 + "name", "a\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = tx.tiled(df, "text", tx.TILE).select("doc_id", "_piece", "_start").collect()
    for row in cut:
        text = re.sub(tx.NON_ASCII, "?", texts[row["doc_id"]])
        assert "".join(row["_piece"]) == text
        assert list(row["_start"]) == [m.start() for m in re.finditer(tx.TILE, text)]


def test_occurrences_with_context(spark):
    df = spark.createDataFrame([(1, "c", "struct A; p->B( x.C")], "doc_id long, filetype string, text string")
    found = {r["name"]: r for r in spans.occurrences(df, ["filetype"], context=True).collect()}
    assert (found["A"]["start"], found["A"]["end"]) == (7, 8)
    assert (found["A"]["word_before"], found["A"]["gap_before"]) == ("struct", " ")
    assert (found["B"]["gap_before"], found["B"]["gap_after"]) == ("->", "( ")
    assert found["struct"]["gap_before"] is None and found["C"]["gap_after"] is None


def _plain_occurrences(texts):
    """Identifiers with their neighbours, read off the folded text one by one."""
    rows = []
    for doc, text in texts:
        cut = list(re.finditer(r"[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+", re.sub(tx.NON_ASCII, "?", text or "")))
        for i, m in enumerate(cut):
            if re.match("[A-Za-z_]", m.group()):
                near = [cut[j].group() if 0 <= j < len(cut) else None for j in (i - 1, i - 2, i + 1, i + 2)]
                rows.append((doc, m.group(), m.start(), m.end(), *near))
    return sorted(rows, key=str)


AROUND = ["doc_id", "name", "start", "end", "gap_before", "word_before", "gap_after", "word_after"]


def test_occurrences_equal_a_plain_reading(spark, rows, monkeypatch):
    """Borders, digits, folding, empty and null texts, null and repeated ids, in blocks of every size."""
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("ab_9 0.é😀\n") for _ in range(rng.randrange(40)))) for i in range(300)]
    texts += [(None, "a1 1a"), (7, None), (7, ""), (7, "12"), (7, "x"), (8, "9z"), (8, "z9"), (8, "日本x😀"), (8, "y")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    expected = _plain_occurrences(texts)
    assert rows(spans.occurrences(df, context=True).select(AROUND)) == expected
    assert rows(spans.occurrences(df).select(AROUND[:4])) == sorted((r[:4] for r in expected), key=str)
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in texts], "text": [t for _, t in texts]})
    for block, out in [(1, 1), (30, 2), (1000, 1 << 20)]:
        monkeypatch.setattr(pieces, "BLOCK_BYTES", block)
        monkeypatch.setattr(pieces, "OUT_ROWS", out)
        found = [r for b in pieces.occurrences_in(batch.slice(3), True, None) for r in b.select(AROUND).to_pylist()]
        assert sorted((tuple(r.values()) for r in found), key=str) == _plain_occurrences(texts[3:])


def test_occurrences_of_wanted_names(spark, rows):
    """Only wanted names leave the cut; null names and names that are gaps find nothing; neighbours stay."""
    texts = [(1, "c", "struct A; b -> A"), (2, "c", "c"), (3, "go", "A b"), (4, None, "A"), (5, "c", "enum B C union B B enum")]
    df = spark.createDataFrame(texts, "doc_id long, filetype string, text string")
    names = spark.createDataFrame(
        [("c", "A", None), ("c", "A", None), ("c", None, None), (None, "A", None), ("c", "; ", None), ("go", "none", None),
         ("c", "B", "enum"), ("c", "C", "enum"), ("c", "C", "union"), ("c", "enum", "union")],
        "filetype string, name string, after string")
    expected = [r for r in _plain_occurrences([t[::2] for t in texts])
                if (r[0], r[1]) in {(1, "A"), (5, "C")} or (r[0], r[1], r[5]) == (5, "B", "enum")]
    assert len(expected) == 4
    assert rows(spans.occurrences(df, ["filetype"], context=True, names=names).select(AROUND)) == expected


def test_occurrences_of_broken_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61ff62e28263') AS string) AS text")
    cut = tx.tiled(df, "text", tx.TILE).first()
    words = [(p, s) for p, s in zip(cut["_piece"], cut["_start"]) if p[0].isalpha()]
    assert [(r["name"], r["start"]) for r in spans.occurrences(df).collect()] == words


def test_context_match_cuts_without_a_pattern(spark):
    """No text goes through the pattern for words and gaps, and few names are dropped before the join."""
    from termindex.plans.registered import QUERIES
    plan = QUERIES["context_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "MapInArrow" in plan


CONTEXT = [
    ("c", "s", "struct A", True), ("c", "s", "struct  A", False), ("c", "s", "A", False),
    ("c", "g", "enum\nA", True), ("c", "u", "union A", True), ("c", "u", "union\n\nA", False),
    ("c", "m", "p->A", True), ("c", "m", "p[1].A", True), ("c", "m", "p .A", False), ("c", "m", ".A", False),
    ("c", "m", "f().A", True), ("c", "m", "p.\nA", False), ("c", "t", "A x", True), ("c", "t", "A.x", False),
    ("c", "t", "A", True), ("cpp", "f", "A (", True), ("cpp", "f", "A;", False), ("c", "f", "A;", True),
    ("go", "f", "A := func", True), ("go", "f", "A := x", False), ("go", "m", "p->A", False), ("go", "m", "p.A", True),
    ("python", "m", ".A", True), ("python", "m", "def A", True), ("python", "m", "x A", False),
    ("python", "f", "def  A", False), ("python", "f", "A", True), ("php", "f", "A(", True), ("php", "f", "A (", False),
    ("vim", "c", "A", True), ("vim", "c", ":A x", False), ("vim", "c", " :A! x", True), ("vim", "c", "x.A", False),
    ("perl", "s", "A", True), ("perl", "s", "x.A", False), ("perl", "s", "&A", True),
]


def test_context_rules(spark):
    df = spark.createDataFrame([(i, ft, kind, text) for i, (ft, kind, text, _) in enumerate(CONTEXT)],
                               "doc_id long, filetype string, kind string, text string")
    placed = spans.occurrences(df, ["filetype", "kind"], context=True).filter("name = 'A'")
    kept = {r["doc_id"] for r in spans.context_match(placed).collect()}
    wrong = [c for i, c in enumerate(CONTEXT) if (i in kept) != c[3]]
    assert wrong == []


def test_masking_equals_brute_force(spark):
    text = ('a "b c" d <!-- e "f" g --> h "i' + " w" * 3000 + '" j <!-- k ' + "z " * 3000 + "--> l < m")
    df = spark.createDataFrame([(1, text), (2, 'x "y" z')], "doc_id long, text string")
    region = re.compile(r'<!--[\s\S]*?-->|"[^"]*"')
    expected = set()
    for doc, t in [(1, text), (2, 'x "y" z')]:
        spans_ = [m.span() for m in region.finditer(t)]
        for m in re.finditer(tx.IDENT, t):
            if not any(a <= m.start() and m.end() <= b for a, b in spans_):
                expected.add((doc, m.group(), m.start(), m.end()))
    joined = spans.mask_regions(spans.occurrences(df), spans.region_spans(df, "markup"), slices=5)
    inline = spans.occurrences_outside(df, "markup")
    partly = spans.occurrences_outside(df, "markup", [".*Comment.*"])
    columns = ["doc_id", "name", "start", "end"]
    assert {tuple(r) for r in joined.select(columns).collect()} == expected
    assert {tuple(r) for r in inline.select(columns).collect()} == expected
    assert expected < {tuple(r) for r in partly.select(columns).collect()}


def test_cleaning_by_language(spark, rows):
    from termindex import config as cfg
    df = spark.createDataFrame([(1, "c", "a /* b */ c"), (2, "python", "a # b"), (3, "lua", "a /* b */ é"), (4, "OBJC", "x//y")],
                               "doc_id long, filetype string, text string")
    on = docs.clean_corpus(df, cfg.languages(spark), cfg.comment_families(spark)).select("doc_id", "text")
    off = docs.clean_corpus(df, cfg.languages(spark), cfg.comment_families(spark), enabled=False).select("doc_id", "text")
    assert rows(on) == [(1, "a c"), (2, "a "), (3, "a /* b */ ?"), (4, "x")]
    assert rows(off) == [(1, "a /* b */ c"), (2, "a # b"), (3, "a /* b */ ?"), (4, "x//y")]


def _outside(occurrences, regions):
    return sorted((d, n, s, e) for d, n, s, e in occurrences if not any(d == r and a <= s and e <= b for r, a, b in regions))


def test_masking_by_overlapping_and_nested_spans(spark):
    """Inside one region, not inside the union of two; ties, empty spans, other documents and nulls."""
    rng = random.Random(4)
    regions, places = [], []
    for doc in range(6):
        for _ in range(60):
            start = rng.randrange(300)
            regions.append((doc, start, start + rng.randrange(40)))
        places += [(doc, f"n{i}", s, s + rng.randrange(8)) for i, s in enumerate(rng.randrange(340) for _ in range(80))]
    places += places[:5] + [(7, "far", 0, 3)]
    occ = spark.createDataFrame(places + [(None, "no document", 1, 2)], "doc_id long, name string, start long, `end` long")
    reg = spark.createDataFrame([(d, "Comment", a, b) for d, a, b in regions] + [(None, "Comment", 0, 9), (7, "Code", 0, 9)],
                                "doc_id long, region string, start long, `end` long")
    for slices in (1, 7, 40):
        got = spans.mask_regions(occ, reg, ["Comment"], slices=slices).select("doc_id", "name", "start", "end").collect()
        assert sorted(tuple(r) for r in got if r[0] is not None) == _outside(places, regions)
        assert [r["name"] for r in got if r[0] is None] == ["no document"]


def test_masking_many_nested_spans_in_one_place(spark):
    """100,000 spans around one another and as many places: no pair is ever tested."""
    n = 100_000
    reg = spark.range(n).selectExpr("1L AS doc_id", "'Comment' AS region", "id AS start", f"{4 * n}L - id AS end")
    occ = spark.range(2 * n).selectExpr("1L AS doc_id", "CAST(id AS string) AS name", "id * 2 + 1 AS start", "id * 2 + 3 AS end")
    left = spans.mask_regions(occ, reg, ["Comment"])
    # The outermost span ends at 4 n; only the last place reaches beyond it.
    assert [tuple(r) for r in left.select("start", "end").collect()] == [(4 * n - 1, 4 * n + 1)]


def test_token_counts(spark, rows):
    """Counted in the row, dealt out before anything is aggregated; rows that repeat an id are one document."""
    table = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, None), (3, ""), (4, "..."), (None, "x x"), (None, "x"), (5, "é:: a:b a:b b")],
                                  "doc_id bigint, text string").withColumn("filetype", F.lit("c"))
    for mode in ("ident", "word", "scoped"):
        folded = table.withColumn("text", tx.ascii_fold("text"))
        plain = docs.tokenize(folded, mode, distinct=False).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))
        counted = docs.token_counts(folded, mode)
        assert "Aggregate" not in counted._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM")[1]
        assert rows(counted) == rows(plain)


def test_parts_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(docs, "SPREAD_BYTES", 100)
    for n in (100, 1000):  # of unknown size: 40 to 60 bytes a row
        table = spark.createDataFrame([(k, "word") for k in range(n)], "doc_id bigint, text string")
        assert 40 * n <= 100 * docs.by_key(table, ["doc_id"], table).rdd.getNumPartitions() <= 60 * n
