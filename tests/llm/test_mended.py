"""Likeness at all lengths, short benchmark items, clashing columns, signatures met in several turns."""

import collections
import pathlib
import random
import re
import time

import numpy as np
import pytest

from termindex.llm import components, cutting_stock, decontamination, fingerprints, jaccard, licenses, packing, secrets, sharding, toxicity


def windows(text, width=fingerprints.WINDOW):
    return {text[max(0, e - width):e] for e in range(1, len(text) + 1)}


def dice(a, b):
    if a == b:
        return 1.0
    a, b = windows(a), windows(b)
    return 2 * len(a & b) / (len(a) + len(b))


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 27, 31, 32, 33, 40, 60])
def test_likeness_at_all_lengths(spark, n):
    """Both columns within 0.1 of the coefficient over all windows, for every pair of lengths next to each other."""
    rng = random.Random(n)
    text = "".join(rng.choice("abcdefgh 中😀") for _ in range(n))
    others = ["", text[:27], text[:-1], text + "x", text[:n // 2] + "#" + text[n // 2 + 1:]]
    rows = []
    for k, other in enumerate(others):
        rows += [(10 * k + 2, text), (10 * k + 1, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    for (key, a), (_, b) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        cut = len(a) // 3
        edited = a[:len(a) - cut] + b[:cut]
        assert abs(got[key].near_edited - dice(a, edited)) <= 0.1, (a, edited)
        assert abs(got[key].near_next - dice(a, b)) <= 0.1, (a, b)


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "Four words, no more"), (2, "今天天气很好我们去公园散步吧"), (3, "unquestionably"), (4, "a b"), (5, None), (None, "four words, no more"),
             (6, "four words no more"), (7, "?!")]
    texts = [(1, "here are FOUR words -- no more of it"), (2, "前面的话今天天气很好我们去公园散步吧后面"), (3, "unquestionably so"),
             (4, "unquestionablyso and four words no moreover"), (5, "a b c"), (6, None), (7, ""), (8, "four words, no more"), (8, "clean"), (None, "x")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(*t, "z") for t in texts], "doc_id long, text string, item_id string")
    found = decontamination.contamination(docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (1, 6), (2, 2), (3, 3), (8, 1), (8, 6)]
    assert {(r.kind, r.share) for r in found} == {("copy", 1.0)}
    assert {r.doc_id: r.first_word for r in found} == {1: 2, 2: 0, 3: 0, 8: 0}
    kept = decontamination.clean(docs, benchmark)
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(
        map(str, docs.select("doc_id", "text").filter("coalesce(doc_id, 0) NOT IN (1, 2, 3, 8) OR text = 'clean'").collect()))


def test_one_of_each_with_columns_of_the_same_names(spark):
    words = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, words, 5, "g", "r"), (2, words + " more", 1, "h", "s"), (None, None, None, None, None)],
                                 "doc_id long, text string, _gone_id long, _gone_hash string, `row` string")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.filter("doc_id IS NULL OR doc_id = 1").collect()))


def test_signatures_met_in_turns(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for k in range(40):
        words = base[:]
        if k % 2:
            words[rng.randrange(200)] = f"x{k}"
        if k % 5 == 0:
            words = [f"v{rng.randrange(500)}" for _ in range(80)]
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(map(tuple, jaccard.near_duplicates(docs).select("doc_id", "component_id").collect()))
    monkeypatch.setattr(jaccard, "MEET", 7)
    assert sorted(map(tuple, jaccard.near_duplicates(docs).select("doc_id", "component_id").collect())) == expected
    assert len({c for _, c in expected}) == 9


ADDED = {
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 40), "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 15), "google": (r"AIza[A-Za-z0-9_-]+", 39),
    "stripe": (r"(?:sk|rk)_live_[A-Za-z0-9]+", 24),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    "bearer": (r"[Bb][Ee][Aa][Rr][Ee][Rr] [A-Za-z0-9+/_.=-]+", 27),
}


def test_added_rules_are_leftmost_and_longest():
    """The second automaton gives what a regular expression gives, on texts made of pieces of the rules."""
    rng = random.Random(8)
    bits = ["ghp_", "gho_", "xoxb-", "AIza", "sk_live_", "rk_live_", "eyJ", ".", ".eyJ", "bearer ", "BEARER ", "abc", "A1" * 9,
            "x" * 21, "-", "_", " ", "\n", "é", "=", "deadbeefdeadbeef", "token=", "AKIA"]
    held = ["".join(rng.choice(bits) for _ in range(rng.randrange(50))) for _ in range(1500)]
    scanner = secrets.compiled(tuple(secrets.RULES))
    for text, found in zip(held, scanner.spans([t.encode() for t in held]), strict=True):
        raw = text.encode()
        got = {(scanner.rules[r].kind, b, e) for b, r, e in found}
        assert {x for x in got if x[0] in ADDED} == {
            (kind, m.start(), m.end()) for kind, (pattern, least) in ADDED.items()
            for m in re.finditer(pattern.encode(), raw) if len(m[0]) >= least}
        base = {(k, len(text[:b].encode()), len(text[:e].encode())) for k, b, e in secrets.plain_spans(text)}
        assert {x for x in got if x[0] in secrets.BASE} == base


def test_private_keys_to_their_end():
    key = "-----BEGIN {0}PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\nMIIEpAIB+/=\nAAA\n-----END {1}PRIVATE KEY-----"
    whole, other = key.format("RSA ", "RSA "), key.format("RSA ", "EC ")
    begin = "-----BEGIN PRIVATE KEY-----"
    scanner = secrets.compiled(tuple(secrets.RULES))
    texts = [f"a\n{whole}\nb", f"{other} {whole}", f"{begin}\nMII{{}}\n-----END PRIVATE KEY-----", begin + whole, "-----END PRIVATE KEY-----"]
    got = [[t[b:e] for b, r, e in found if scanner.rules[r].kind.startswith("key")]
           for t, found in zip(texts, scanner.spans([t.encode() for t in texts]), strict=True)]
    assert got == [[whole], ["-----BEGIN RSA PRIVATE KEY-----", whole], [begin], [begin, whole], []]


def test_long_runs_of_heads_take_time_in_proportion():
    scanner = secrets.compiled(tuple(secrets.RULES))

    def took(n, bit):
        begin = time.perf_counter()
        (found,) = scanner.spans([(bit * (n // len(bit))).encode()])
        return time.perf_counter() - begin, len(found)

    for bit in ("eyJ", "eyJa.", "ghp_", "-----BEGIN "):
        took(10_000, bit)
        (short, _), (long, _) = took(20_000, bit), took(200_000, bit)
        assert long <= 20 * short + 1, (bit, short, long)


def test_exceptions_are_merged():
    """As one by one; and a text that repeats an exception phrase takes time in proportion."""
    lexicon = toxicity.Lexicon({" idiot ": (30, 0), " idio": (30, 0), " scum ": (30, 0), " not ": (30, 0)}, 60, 600, 10, (-1.0, 1.0),
                               ("not an idiot", "idiot scum", "not an"))
    matcher = toxicity.Matcher(lexicon)
    rng = random.Random(5)
    for _ in range(300):
        text = " ".join(rng.choice(["not", "an", "idiot", "scum", "tea"]) for _ in range(rng.randrange(30)))
        folded = toxicity.fold(text)
        exempt = [m for p in lexicon.exceptions for m in re.finditer(f"(?={toxicity.fold(p)})", folded)
                  for m in [range(m.start(), m.start() + len(toxicity.fold(p)) - 1)]]
        hits = {m.start() for term in lexicon.weights() for m in re.finditer(f"(?={term})", folded)}
        assert matcher.density(text)[1] == len([h for h in hits if not any(h in e for e in exempt)]), text
    begin = time.perf_counter()
    assert matcher.density("not an idiot idiot " * 60_000)[1] == 60_000
    assert time.perf_counter() - begin < 10


FULL = {"Apache-2.0": ["Apache-2.0"], "BSD": ["BSD-3-Clause"], "CC0-1.0": ["CC0-1.0"], "GPL-2": ["GPL-2.0"], "GPL-3": ["GPL-3.0"],
        "LGPL-2": ["LGPL-2.0"], "LGPL-2.1": ["LGPL-2.1"], "LGPL-3": ["LGPL-3.0"], "MPL-1.1": ["MPL-1.1"], "MPL-2.0": ["MPL-2.0"],
        "Artistic": []}
MPL_HEADER = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""


def test_whole_licence_texts(spark):
    """The texts that a Debian system carries, each by itself, after a notice, and behind "all rights reserved"."""
    folder = pathlib.Path("/usr/share/common-licenses")
    have = [n for n in FULL if (folder / n).is_file()]
    full = {n: (folder / n).read_text(errors="replace") for n in have}
    cases = {n: (full[n], FULL[n]) for n in have}
    cases["header"] = MPL_HEADER, ["MPL-2.0"]
    cases["reserved"] = "Copyright 2020 X Ltd.\nAll rights reserved.\n", ["Proprietary"]
    cases["reserved far above"] = "All rights reserved.\n" + "One more line of text.\n" * 30 + MPL_HEADER, ["MPL-2.0", "Proprietary"]
    cases["reserved beside"] = "Copyright 2020 X Ltd. All rights reserved.\n" + MPL_HEADER, ["MPL-2.0"]
    if "GPL-3" in full:
        cases["notice and text"] = GPL_NOTICE + "\n" + full["GPL-3"], ["GPL-3.0-or-later"]
        cases["notice behind the text"] = full["GPL-3"] + "Line.\n" * 80 + GPL_NOTICE, ["GPL-3.0-or-later"]
    df = spark.createDataFrame([(n, t) for n, (t, _) in cases.items()], "doc_id string, text string")
    assert {r.doc_id: r.licenses for r in licenses.scan_licenses(df).collect()} == {n: want for n, (_, want) in cases.items()}


def test_each_known_sentence_has_a_telling_word():
    spdx = ["spdx license identifier " + licenses.spoken(n) for n in licenses.SPDX]
    for sentence in [*licenses.SENTENCES.values(), *spdx, *[p for p, _ in licenses.SLOTS]]:
        assert re.search(licenses.TELLING, sentence.replace("acknowledge?ment", "")), sentence


# Operators 7 and 10

def test_configurations_are_optimised():
    """Where the fullest configurations first are not the best: the plan is within 1 % of the linear program's bound."""
    rng = np.random.default_rng(5)
    counts = collections.Counter((2 * rng.integers(65, 150, 20000)).tolist())
    sizes = np.array(sorted(counts, reverse=True))
    have = np.array([counts[x] for x in sizes.tolist()])
    bound = sum(x for x, _ in cutting_stock.generate(sizes, have.astype(float), 512))
    greedy = sum(times for times, _ in packing.fullest(sizes, have, 512))
    placed = packing.plan(counts, 512, small=100)
    used = max(first + n for _, _, n, first, _ in placed)
    assert sum(n for _, _, n, _, _ in placed) == 20000
    assert used <= 1.01 * bound and used < greedy


def test_first_basis_covers_all_pieces():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        sizes = np.sort(rng.choice(np.arange(26, 101), 30, replace=False))[::-1]
        have = rng.integers(1, 50, 30)
        basis = packing.first_basis(sizes, have, 100)
        assert (sizes @ basis <= 100).all()
        times = np.linalg.solve(basis, have)
        assert (times > -1e-9).all() and times.sum() <= 1.05 * sum(t for t, _ in packing.fullest(sizes, have, 100))


def test_rooms_beyond_the_sampler():
    """Totals over 10**9 are halved first: margins are exact and means right."""
    matrix = sharding.communication_matrix([4 * 10**9, 10**9, 0], [10**9] * 5, 3)
    assert matrix.sum(axis=1).tolist() == [4 * 10**9, 10**9, 0] and matrix.sum(axis=0).tolist() == [10**9] * 5
    assert abs(matrix[1] - 2 * 10**8).max() < 10**6


def test_latent_space_is_fitted_on_all_items_and_no_sample():
    """Products with items are those of the weighted words, exactly, however many items there are."""
    rng = np.random.default_rng(4)
    items = [rng.integers(1, 600, size=12).tolist() for _ in range(300)]
    weight = np.concatenate([[0], rng.random(600) + 0.1]).astype(np.float32)
    bench = decontamination.Benchmark(list(range(300)), items, {}, weight)
    decontamination.latent_space(bench)
    words = np.zeros((300, 601))
    for i, item in enumerate(items):
        np.add.at(words[i], item, 1)
    weighted = words * weight
    exact = weighted @ weighted.T / np.linalg.norm(weighted, axis=1)
    assert np.allclose(words @ bench.basis @ bench.latent.T, exact, rtol=1e-3, atol=1e-3)
    assert not hasattr(decontamination, "SAMPLE_TEXTS")


@pytest.mark.parametrize("block", [jaccard.BLOCK, 16])
def test_family_writes_a_forest_not_its_pairs(spark, monkeypatch, block):
    """Two kinds of similar sets in one family, no two of them in one component so far, and a set like none of them."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(5)
    kinds = [rng.integers(0, 1 << 62, 400).astype(np.uint64) for _ in range(2)]
    sets = [np.unique(np.concatenate([kinds[i % 2], rng.integers(0, 1 << 62, 20).astype(np.uint64)])) for i in range(120)]
    sets.append(np.unique(np.concatenate([kinds[0][:290], kinds[1][:130]])))
    groups = spark.createDataFrame([(-1, i, i, len(s), jaccard.parities(s)) for i, s in enumerate(sets)],
                                   "hub long, node long, comp long, n long, bitmap binary")
    held = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "class long, set binary")
    met = jaccard.across(groups)
    assert {r.node for r in met.collect()} >= set(range(120)) and met.count() <= len(sets)
    links = jaccard.forest(groups.join(met, ["hub", "node"], "left_semi"), held)
    assert links.count() <= (118 if block > len(sets) else 118 * 8)
    assert {tuple(r) for r in components.components(links).collect()} == {(i, i % 2) for i in range(120)}


@pytest.mark.parametrize("block", [jaccard.BLOCK, 16])
def test_families_link_members_that_do_not_name_their_component(spark, monkeypatch, block):
    """Forty sets of one component, numbered by the first, and two each of which is similar to the last of them only."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(7)
    base, own = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (400, 200))
    sets = [np.unique(np.concatenate([base, rng.integers(0, 1 << 62, 20).astype(np.uint64)])) for _ in range(39)]
    sets.append(np.unique(np.concatenate([base, own[:80]])))
    sets += [np.unique(np.concatenate([base[:390], own, rng.integers(0, 1 << 62, k).astype(np.uint64)])) for k in (5, 9)]
    comps = [0] * 40 + [40, 41]
    near = [(i, j) for j in (40, 41) for i in range(j) if jaccard.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    assert near == [(39, 40), (39, 41), (40, 41)]
    groups = spark.createDataFrame([(-1, i, c, len(s), jaccard.parities(s)) for i, (c, s) in enumerate(zip(comps, sets, strict=True))],
                                   "hub long, node long, comp long, n long, bitmap binary")
    held = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "class long, set binary")
    met = jaccard.across(groups)
    assert {r.node for r in met.collect()} >= {39, 40, 41}
    links = jaccard.forest(groups.join(met, ["hub", "node"], "left_semi"), held)
    assert {(0, r.comp) for r in components.components(links).collect()} == {(0, 39)}
    assert {r.node for r in components.components(links).collect()} == {39, 40, 41}


def test_similar_to_is_the_exact_test():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, size + 9, size).astype(np.uint64)) for size in rng.integers(1, 40, 300)]
    for one in sets[:60]:
        assert jaccard.similar_to(one, sets).tolist() == [
            jaccard.similar(len(np.intersect1d(one, s)), len(one), len(s)) for s in sets]


def test_words_are_runs_of_word_characters():
    rng = random.Random(8)
    for chars in ("".join(map(chr, range(128))), "".join(map(chr, range(256))) + "İẞ中́ "):
        for _ in range(200):
            text = "".join(rng.choice(chars) for _ in range(60))
            assert decontamination.words_of(text) == re.findall(r"\w+", text.lower())


def test_latent_space_only_where_an_item_has_mass():
    words = [f"w{i}" for i in range(40)]
    number = {w: i for i, w in enumerate(words, start=1)}
    weight = np.append(np.float32(0), np.ones(40, np.float32))
    bench = decontamination.Benchmark([7], [list(range(1, 41))], number, weight)
    decontamination.latent_space(bench)
    search = bench.search()
    assert search.found("other words " + " ".join(words))[0][0] == "copy"
    bench.latent = bench.basis = None
    assert search.found("other words only, and w3 w5 once") == {}
