"""Cutting-stock packing, the Merkle manifest and fill-in-the-middle against plain versions in Python."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termindex.llm import cutting_stock, infill, merkle

WORDS = "/opt/tokenizers/word_bpe_49k.json"
NAMES = ["hash", "tree", "rank", "block", "node", "load", "p", "nth", "ids", "length", "n", "form", "h1", "output", "_u", "again"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def table():
    """(doc_id, text, lang, source, n_chars) with every awkward case and one hot source."""
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{rng.randrange(300)}\n"[: rng.randrange(1, 6)] for _ in range(rng.randrange(1, 60))), "en",
             "hot" if k % 3 else f"s{k % 7}", k) for k in range(120)]
    rows += [(200, None, None, None, None), (201, "", "", "", 0), (202, " \n\t ", "é", None, 3), (203, "x" * 300_000 + "é中😀\n" * 9000, "en", "long", 1),
             (204, "a <P> b <S>", "en", "marks", 9), (204, "same id", "en", "marks", 9), (205, "again\nagain", "en", "hot", 1),
             (205, "again\nagain", "en", "hot", 1), (None, "no id\none", "en", "hot", None), (None, "no id\ntwo", "en", "hot", None),
             (206, "İSTANBUL ΣΑΣ <|endoftext|> ª²½ é ́ 'S don't\x01\x02", "tr", "alone", 5), (207, "<P", "en", "marks", 2), (208, "😀", "en", "marks", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, table):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *["z"] * len(NAMES)) for r in table], schema).repartition(4)


def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


# ---- op11

def tokens(text):
    library = cutting_stock.Words(WORDS).library
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(rows, capacity, least=1):
    """Rows are (doc_id, start, length, crc, doc_tokens, sequence, offset, ids): no gap, no overlap; the fill of each sequence."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    fills = []
    for of in by_sequence.values():
        at = 0
        for offset, length in sorted(of):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        fills.append(at)
    if least == 1:
        assert all(f & (f - 1) == 0 for f in fills)
        assert sum(f < capacity for f in fills) <= capacity.bit_length()
    return fills


@pytest.mark.parametrize("capacity", [16, 512, 4096])
def test_packing_keeps_every_id_once(docs, table, capacity):
    rows = cutting_stock.pack(docs, WORDS, capacity, with_ids=True).collect()
    check_packing(rows, capacity)
    documents = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        documents.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    expected = {}
    for key, text, *_ in table:
        ids = tokens(text)
        expected.setdefault((key, len(ids)), []).append(np.array(ids, dtype="<u4").tobytes())
    assert set(documents) == set(expected)
    for key, of in documents.items():
        if len(expected[key]) == 1:  # an id of one row: its pieces, in order, are its ids
            at = 0
            for r in of:
                assert r["start"] == at
                at += r["length"]
            assert b"".join(r["ids"] for r in of) == expected[key][0]
        else:
            assert sum(r["length"] for r in of) * 4 == sum(map(len, expected[key]))


def test_packing_query_columns_and_least(docs, spark):
    rows = cutting_stock.pack(docs, WORDS, 64, least=5, with_ids=True).collect()
    assert all(f > 64 - 5 or f & (f - 1) == 0 for f in check_packing(rows, 64, least=5))
    assert cutting_stock.pack(none(spark), WORDS).collect() == []
    assert cutting_stock.pack(docs, WORDS).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_words_equal_the_library():
    words = cutting_stock.Words(WORDS)
    rng = random.Random(3)
    alphabet = "abcXYZ'sSrRé ÉÈñœŒſıİµª²½ΣσςÅÅ中😀́\x01\x02\x0b\x1c\x85\xa0 ,.<|>_-09ﬁǅ한글\t\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["x<|endoftext|>y <|endoftext|> Z", "it's IT'S we'll 'd '''s don't", "", " ", "\n"]
    for text, ids in zip(texts, words.ids(pa.array(texts)), strict=True):
        assert ids.tolist() == words.library.encode(text, add_special_tokens=False).ids, text
    assert [len(x) for x in words.ids(pa.array(["", "  "]))] == [0, 0]
    sliced = pa.array(["one two", "three", "", "four five six"]).slice(1)
    assert [x.tolist() for x in words.ids(sliced)] == [words.library.encode(t.as_py(), add_special_tokens=False).ids for t in sliced]


def test_knapsack_finds_the_best_pattern():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = np.sort(rng.choice(np.arange(1, 25), size=4, replace=False))[::-1]
        worth = rng.random(4)
        value, pattern = cutting_stock.best_pattern(sizes, worth, 30)
        counts = np.indices([30 // s + 1 for s in sizes]).reshape(4, -1)
        best = max(float(worth @ c) for c in counts.T if sizes @ c <= 30)
        assert abs(value - best) < 1e-9 and abs(float(worth @ pattern) - best) < 1e-9 and sizes @ pattern <= 30


def test_column_generation_reaches_the_linear_optimum():
    # Pairs (7, 3) and (6, 4) fill a sequence of 10; nothing else does as well.
    found = cutting_stock.generate(np.array([7, 6, 4, 3]), np.array([40.0, 60.0, 60.0, 40.0]), 10, 1e-9)
    assert abs(sum(x for x, _ in found) - 100) < 1e-6
    # Three pieces of 34 of 100 do not fit, two do: 50 sequences are needed.
    assert abs(sum(x for x, _ in cutting_stock.generate(np.array([34]), np.array([100.0]), 100)) - 50) < 1e-6


@pytest.mark.parametrize("seed", range(6))
def test_plans_have_no_padding_and_cut_little(seed):
    rng = np.random.default_rng(seed)
    counts = {}
    for n in np.minimum(np.exp(rng.normal(4 + seed / 2, 1.2, 3000)).astype(int) + 1, 30_000).tolist():
        for start in range(0, n, 1024):
            counts[min(1024, n - start)] = counts.get(min(1024, n - start), 0) + 1
    plan = cutting_stock.Plan(counts, 1024)
    total = sum(length * n for length, n in counts.items())
    assert plan.sequences <= total // 1024 + 11
    placed = {}
    for length, first, count, *_ in [*plan.whole, *plan.stream]:
        placed.setdefault(length, []).append((first, count))
    for length, n in counts.items():  # the ranks of a length are all placed, each once
        at = 0
        for first, count in sorted(placed[length]):
            assert first == at
            at += count
        assert at == n
    assert sum(n * width for _, n, width, *_ in plan.gaps) == sum(length * n for length, _, n, _ in plan.stream)
    cut = sum(n for _, _, n, _ in plan.stream)
    assert cut <= 0.05 * sum(counts.values()), cut


def test_plan_of_awkward_lengths():
    for counts in ({}, {1: 1}, {600: 1000}, {1024: 7}, {513: 3, 512: 1}, {1: 5000}):
        plan = cutting_stock.Plan(counts, 1024)
        total = sum(length * n for length, n in counts.items())
        assert plan.sequences <= total // 1024 + 11
        assert sum(n * length for length, _, n, *_ in [*plan.whole, *plan.stream]) == total


# ---- op12

def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(hashes, fan):
    """(root, path of each leaf) with the siblings before and after at each level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i - i % fan
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1:run + fan])))
        level = [sha(*level[i:i + fan]) for i in range(0, len(level), fan)]
        at = [i // fan for i in at]
    return level[0], paths


def manifest(rows, fan=3):
    """The contract by sorted lists: a Counter-able list of tuples."""
    by_source = {}
    for key, text, lang, source, n in rows:
        leaf = sha(*map(field, (key, source, lang, n, text)))
        other = text.replace("\n", "") if text is not None and key is not None and zlib.crc32(str(key).encode()) % 2 == 0 else text
        by_source.setdefault(source, []).append((key, leaf, sha(*map(field, (key, source, lang, n, other)))))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tree([r[1] for r in by_source[s]], fan)
    root, tops = tree([trees[s][0] for s in names], fan)
    out = []
    for s, top in zip(names, tops, strict=True):
        for (key, leaf, other), path in zip(by_source[s], trees[s][1], strict=True):
            held = other
            for before, after in path + top:
                held = sha(before, held, after)
            out.append((key, leaf, trees[s][0], root, sha(*[b + a for b, a in path + top]), held, held == root))
    return sorted(out, key=str)


def proved(docs, **sizes):
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    found = merkle.manifest(docs, {"text": F.when(picked, F.translate("text", "\n", "")).otherwise(F.col("text"))}, **sizes)
    return sorted(map(tuple, found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")),
                                          "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(docs, table, levels):
    """Blocks of 3, 9 and 729 rows: up to five stages, the same proofs."""
    expected = manifest(table)
    assert proved(docs, levels=levels) == expected
    assert {v for *_, v in expected} == {True, False}


def test_manifest_of_other_fan_and_exact_blocks(spark):
    for n, fan, levels in ((1, 3, 1), (9, 3, 2), (10, 3, 2), (27, 3, 1), (17, 2, 2)):
        rows = [(k, f"t{k}\n", "en", "s", k) for k in range(n)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        assert proved(docs, fan=fan, levels=levels) == manifest(rows, fan)


def test_manifest_of_an_empty_table(spark):
    assert proved(none(spark)) == []


# ---- op13

def infilled(key, text, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    n, digest = len(text), sha(f"1:{'' if key is None else key}")
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= 90:
        return (key, n, "plain", None, None, text)
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    p, s, m = marks
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (key, n, "spm", a, b - a, s + suffix + p + prefix + m + middle)
    return (key, n, "psm", a, b - a, p + prefix + s + suffix + m + middle)


def test_fill_in_middle(docs, table, spark):
    made = infill.fill_in_middle(docs)
    rows = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted([tuple(r)[:6] for r in rows], key=str) == sorted([infilled(r[0], r[1]) for r in table], key=str)
    assert sorted([r["back"] for r in rows]) == sorted([r[1] or "" for r in table])
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(none(spark)).collect() == []


def test_pieces_do_not_depend_on_the_stretch():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aé中😀 \n") for _ in range(rng.randrange(50))) for _ in range(300)] + ["", "中" * 5000]
    ends = [sorted([rng.randrange(len(t) + 1), rng.randrange(len(t) + 1)]) for t in texts]
    a, b = np.array([e[0] for e in ends]), np.array([e[1] for e in ends])
    expected = [[t[:x] for t, x in zip(texts, a, strict=True)], [t[x:y] for t, x, y in zip(texts, a, b, strict=True)],
                [t[y:] for t, y in zip(texts, b, strict=True)]]
    for limit in (1, 7, 64, 1 << 20):
        assert [x.to_pylist() for x in infill.cut(pa.array(texts), a, b, limit)] == expected
    sliced = pa.array(texts).slice(10, 100)
    assert [x.to_pylist() for x in infill.cut(sliced, a[10:110], b[10:110], 64)] == [e[10:110] for e in expected]


def test_marks_that_could_overlap_are_refused(docs):
    for marks in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>"), ("<P", "P>", "<M>")):
        with pytest.raises(ValueError, match="marks"):
            infill.fill_in_middle(docs, marks=marks)
