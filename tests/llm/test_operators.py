"""Each operator on a small table with nulls, ties, repeated rows and clashing columns, against brute force."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from termindex.llm import (chat, components, decontamination, fingerprints, jaccard, licenses, line_dedup, packing,
                           secrets, sharding, toxicity)

PATH = "/opt/tokenizers/byte_bpe_50k.json"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def table():
    """(doc_id, text) with every awkward case."""
    base = words(300, 1)
    near = base[:]
    near[150] = "changed"
    far = base[:120] + words(180, 2)
    rows = [(k, " ".join(words(40 + 7 * k, 100 + k))) for k in range(20)]
    rows += [(20, " ".join(base)), (21, " ".join(near)), (22, " ".join(far)), (23, " ".join(base).upper()),
             (24, None), (25, ""), (26, " \t\n "), (27, "one two"), (28, "One TWO"), (29, "a\n\nb\n"),
             (30, "A shared line here\nown 30\nA shared line here"), (31, " a SHARED line here\t\nown 31"),
             (32, "a shared line here"), (33, "x" * 70_000), (34, "é中😀 " * 500), (34, "another text of id 34"),
             (35, "repeated row of some words"), (35, "repeated row of some words"),
             (None, "text without an id, first"), (None, "text without an id, second"), (None, None),
             (36, "a shared line here\r\nshort\nshort\n\x0ba shared line here\x0c")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, table):
    """The table with extra columns that clash with internal names."""
    names = ["id", "text_hash", "row", "keep", "p", "u", "h1", "class", "n", "line_no", "lines", "words"]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(i, t, *["z"] * len(names)) for i, t in table], schema).repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not found:
        return frozenset()
    return frozenset([tuple(found)] if len(found) < 5 else zip(*[found[i:] for i in range(5)], strict=False))


def grouped(rows):
    """Brute force: (index of row) -> smallest id that links reach, or None."""
    sets = [shingles(t) for _, t in rows]
    home = list(range(len(rows)))

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                home[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), LAST), LAST if key is None else key)
    return [(None if least[find(i)] == LAST else least[find(i)], len(sets[i])) for i in range(len(rows))]


# Operator 1

def check_groups(docs, rows):
    want = collections.Counter((k, n, c) for (k, _), (c, n) in zip(rows, grouped(rows), strict=True))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert got == want


def test_jaccard_awkward(docs, table):
    check_groups(docs, table)


def test_jaccard_chains_and_passages(spark):
    rng, rows = random.Random(5), []
    for family in range(6):  # chains of small edits, in sizes from 8 words on
        text = words(8 * 2**family, 50 + family, 5000)
        for _ in range(12):
            text = text[:]
            for _ in range(max(1, len(text) // 60)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            rows.append(text)
    passage = words(60, 77, 5000)
    rows += [words(n, 900 + n, 5000) + passage for n in range(1, 60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(rows)]
    check_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_jaccard_bands_cover_all_pairs():
    low, k = jaccard.bands(3000)
    band = lambda n: int(np.searchsorted(low, n, side="right")) - 1
    for a in range(3, 1500):
        b = 4 * a // 3
        assert band(b) - band(a) <= 1
        assert (a + b) // 7 <= k[band(a)] and (2 * a) // 7 <= k[band(a)]


def test_jaccard_signatures_meet():
    rng, held = random.Random(3), jaccard.Bands()
    none = np.zeros(0, dtype=np.uint64)
    for n in [*range(4, 40), 80, 200, 500]:
        for _ in range(6):
            a = {rng.randrange(2**64) for _ in range(n)}
            while True:  # as different as similarity allows
                b = set(a)
                for _ in range(rng.randrange(n // 3 + 1)):
                    b.discard(rng.choice(sorted(b)))
                for _ in range(rng.randrange(n // 3 + 1)):
                    b.add(rng.randrange(2**64))
                if len(b) >= 3 and jaccard.similar(len(a & b), len(a), len(b)):
                    break
            some = np.array(sorted(rng.sample(sorted(a), n // 2)), dtype=np.uint64)
            for frequent in (none, some):
                x, y = (set(jaccard.signatures(np.array(sorted(s), dtype=np.uint64), frequent, held)) for s in (a, b))
                assert a == b or x & y


def test_one_of_each(spark, docs, table):
    kept = collections.Counter((r.doc_id, r.text) for r in jaccard.one_of_each(docs).select("doc_id", "text").collect())
    seen, want = set(), collections.Counter()
    by_home = collections.defaultdict(list)
    sets = [shingles(t) for _, t in table]
    for i, (key, text) in enumerate(table):
        for home in by_home:
            if sets[i] and any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in by_home[home]):
                by_home[home].append(i)
                break
        else:
            by_home[i].append(i)
    for group in by_home.values():
        first = min(group, key=lambda i: LAST if table[i][0] is None else table[i][0])
        want.update(table[i] for i in group if table[i] == table[first])
        seen.update(group)
    assert kept == want
    assert jaccard.one_of_each(empty(spark)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (7000, 7000), (500, 400), (400, 450)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000, 400: 400, 450: 400, 500: 400}


# Operator 2

def test_fold():
    assert toxicity.fold("You're a St0pid 1d10t!! іdiot Café tr@sh 2024") == " you re a stopid idiot idiot cafe trash 2024 "
    assert toxicity.fold("") == "  " and toxicity.fold("...") == "  "


def toxic_rows(n, seed):
    rng, rows, labels = random.Random(seed), [], []
    for k in range(n):
        text, bad = words(rng.randrange(20, 120), seed + k, 900), rng.random() < 0.2
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "SCUM", "1d1ot", "plonkheads", "plonkish"]))
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity(spark, docs):
    rows, labels = toxic_rows(900, 7)
    rows += [(5000, "scum idiot"), (5001, None), (5002, "the idiot proof lid")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 0)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, marks, exceptions=("idiot proof",)).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    held = [(k, y) for k, y in labels if got[k].held_out]
    assert sum(got[k].predicted == y for k, y in held) >= 0.97 * len(held)
    assert got[5000].predicted == 1 and got[5001].predicted == 0 and got[5002].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    kept = toxicity.accepted(df, marks, exceptions=("idiot proof",))
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.predicted}
    nothing = marks.limit(0)
    assert {r.predicted for r in toxicity.toxicity(docs, nothing).collect()} == {0}
    assert toxicity.toxicity(empty(spark), marks).count() == 0


# Operator 3

def test_fingerprints(spark, docs, table):
    order = sorted(table, key=lambda r: -(LAST if r[0] is None else r[0]))
    rows = fingerprints.fingerprints(docs, buckets=5).collect()
    assert len(rows) == len(table)
    got = {r.doc_id: r for r in rows}
    plain = [(k, t or "") for k, t in order]
    for i, (k, text) in enumerate(plain):
        after = plain[(i + 1) % len(plain)]
        if k in (None, 34, 35) or after[0] in (None, 34, 35):
            continue  # several rows of one id
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[1][:cut]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[k].n_chars == len(text)
        assert got[k].edited_fingerprint == fingerprints._Held(0, edited, fingerprints.Powers()).print
        assert got[k].common_edited == len(os.path.commonprefix([text, edited]))
        assert got[k].common_next == len(os.path.commonprefix([text, after[1]]))
    prints = collections.defaultdict(set)
    for r in rows:
        prints[r.fingerprint].add(r.n_chars)
    assert len(prints) == len({t or "" for _, t in table})  # equal texts, equal prints; others differ here
    assert fingerprints.fingerprints(empty(spark)).count() == 0
    alone = spark.createDataFrame([(1, "alone")], "doc_id bigint, text string")
    assert fingerprints.fingerprints(alone).first().near_next == 1.0


def test_spans():
    powers = fingerprints.Powers()
    make = lambda s: fingerprints.PrefixHashes(np.frombuffer(s.encode("utf-32-le"), np.uint32), powers)
    a, b = make("abcabcabd"), make("xxabcabcabe")
    assert fingerprints.spans_equal(a, 0, a, 3, 3) and not fingerprints.spans_equal(a, 0, a, 3, 6)
    assert fingerprints.common_extension(a, b, 0, 2) == 8 and fingerprints.common_extension(a, b) == 0
    assert fingerprints.spans_equal(make("\0"), 0, make(""), 0, 0) and make("\0").span(0, 1) != make("\0\0").span(0, 2)


# Operator 4

def test_secrets(spark, docs, table):
    rng = random.Random(4)
    bits = ["password", "PassWd", "secret", "token", "apikey", "API_key", "=", ":", " ", "'", '"', "AKIA", "=", "é", "\n",
            "ABCDEFGH1234567", "abcdef0123456789", "x", "deadbeefdeadbeef", "ghp_" + "a1" * 20, "ſecret", "Key"]
    rows = [*table, *[(1000 + k, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for k in range(400)]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = collections.Counter(
        (r.doc_id, tuple(tuple(s) for s in r.spans if s.kind in secrets.BASE)) for r in secrets.scan_secrets(df, batch_bytes=3000).collect())
    assert got == collections.Counter((k, tuple(secrets.plain_spans(t or ""))) for k, t in rows)
    assert secrets.scan_secrets(docs).count() == len(table) and secrets.scan_secrets(empty(spark)).count() == 0


def test_added_secrets(spark):
    text = "é ghp_" + "aB3" * 12 + " and eyJhbGciOi.eyJzdWIiOiI.abcDEF_-12345 xoxb-123456789012 AIza" + "k" * 35
    spans = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().spans
    found = {s.kind: text[s.start:s.end] for s in spans}
    assert found["github"] == "ghp_" + "aB3" * 12 and found["jwt"].startswith("eyJ") and found["jwt"].endswith("12345")
    assert found["slack"] == "xoxb-123456789012" and len(found["google"]) == 39


# Operator 5

def test_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(15))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        assert decontamination.common_subsequence(a, b) == row[-1]


def test_decontamination(spark, docs):
    rng = random.Random(9)
    items = [(k, " ".join(words(rng.randrange(15, 60), 300 + k, 3000))) for k in range(40)]
    rows, want = [], set()
    for k in range(160):
        text = words(rng.randrange(0, 400), 5000 + k, 3000)
        if k % 4 == 0:
            item = items[rng.randrange(40)]
            told = item[1].split()
            if k % 8 == 0:  # a paraphrase: a fifth of the words changed, the last ones kept
                for at in rng.sample(range(len(told) - max(3, len(told) // 4)), len(told) // 5):
                    told[at] = "other"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + "," for w in told]
            want.add((k, item[0]))
        rows.append((k, " ".join(text)))
    rows += [(900, None), (None, items[3][1]), (901, "")]
    want.add((None, 3))
    bench = spark.createDataFrame([*items, (None, "nothing to see here at all"), (77, None), (78, "w1 w2")], "item_id bigint, text string")
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for at_once in (1024, 15):
        got = decontamination.contamination(df, bench, items_at_once=at_once).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    kept = decontamination.clean(df, bench).collect()
    assert len(kept) == len(rows) - len(want)
    assert not {r.doc_id for r in kept} & {k for k, _ in want}
    assert decontamination.contamination(empty(spark), bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).count() == 0
    assert decontamination.clean(docs, bench).count() == docs.count()


def test_copy_among_the_rare_words_of_its_item(spark):
    rng = random.Random(10)
    common, rare = [f"c{k}" for k in range(60)], [f"r{k}" for k in range(900)]
    items, rows = [], []
    for k in range(60):
        told = [rng.choice(common) for _ in range(rng.randrange(15, 60) if k % 3 else 8)]
        own = rare[3 * k:3 * k + 3]
        for at, w in zip(rng.sample(range(len(told)), 3), own, strict=True):
            told[at] = w
        text = [rng.choice(own) if rng.random() < 0.3 else rng.choice(common) for _ in range(300)]
        at = rng.randrange(len(text) + 1)
        text[at:at] = told
        items.append((k, " ".join(told)))
        rows.append((k, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(rows + [(1000 + k, " ".join(rng.choice(common) for _ in range(300))) for k in range(60)],
                               "doc_id bigint, text string")
    got = {r.doc_id: r for r in decontamination.contamination(df, bench).collect() if r.doc_id == r.item_id}
    assert set(got) == set(range(60)) and {r.share for r in got.values()} == {1.0}
    assert not [r for r in decontamination.clean(df, bench).collect() if r.doc_id < 60]


def test_check_is_the_best_of_all_spans():
    rng = random.Random(11)
    found = 0
    for _ in range(300):
        item = [rng.randrange(1, 15) for _ in range(rng.randrange(5, 20))]
        numbers = np.array([rng.randrange(40) if rng.random() < 0.8 else rng.choice(item) for _ in range(120)])
        told = [w if rng.random() < 0.8 else 0 for w in item]
        at = rng.randrange(100)
        numbers[at:at + len(told)] = told[:120 - at]
        holds = np.zeros(40)
        holds[item] = 1
        span, begin, end = len(item) + len(item) // 4 + 2, 40, 80
        answer, want = item[-max(3, len(item) // 4):], []
        for k in range(max(0, begin - span), min(len(numbers), end + span)):
            near = numbers[k:min(k + span, end + span)].tolist()
            share = decontamination.common_subsequence(item, near) / len(item)
            answered = share >= 0.5 and decontamination.common_subsequence(answer, near) >= 0.75 * len(answer)
            want.append((share >= 0.7 or answered, share))
        share, answered, _ = decontamination.check(item, numbers, begin, end, holds)
        if max(want)[0]:
            found += 1
            assert (share >= 0.7 or answered, share) == max(want)
        else:
            assert share < 0.7 and not answered
    assert 50 < found < 300


# Operator 6

APACHE = """some code
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""


def test_licenses(spark, docs, table):
    gap = " Filler sentence." * 9
    cases = {
        1: ("Released under the MIT License.", ["MIT"]), 2: ("Prose.\nAll rights reserved.\nMore.", ["Proprietary"]),
        3: (APACHE, ["Apache-2.0"]), 4: ("// SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
        5: ("Licensed under CC BY-NC 4.0.\nReleased under the MIT licence.", ["CC-BY-NC-4.0", "MIT"]),
        6: ("It mentions a license only.", []), 7: (None, []), 8: ("", []),
        9: ("This program is free software:" + gap + " you can redistribute it and/or modify it under the terms of the GNU"
            " General Public License as published by the Free Software Foundation, either version 3 of the License, or"
            " (at your option) any later version.", []),
        10: ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General"
             " Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your"
             " option) any later version.", ["GPL-3.0-or-later"]),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert {k: r.licenses for k, r in got.items()} == {k: w for k, (_, w) in cases.items()}
    assert got[3].rules[0].kind == "header"
    assert licenses.scan_licenses(docs).count() == len(table) and licenses.scan_licenses(empty(spark)).count() == 0


BSD = """Copyright (c) 2011 Example.
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

  {}Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
  {}Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
"""
NEITHER = """  {}Neither the name of {} nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
GNU = """ * This {0} is free software; you can redistribute it and/or
 * modify it under the terms of the GNU {1}General Public
 * License as published by the Free Software Foundation; {2}
"""


def test_licenses_with_names_and_list_marks(spark):
    later = "either\n * version {} of the License, or (at your option) any later version."
    linux = ("// This program is free software; you can redistribute it and/or modify\n// it under the terms of the GNU General"
             " Public License version 2 as\n// published by the Free Software Foundation.\n")
    cases = {
        1: (BSD.format("* ", "* ") + NEITHER.format("* ", "Google Inc."), ["BSD-3-Clause"]),
        2: (BSD.format("(1) ", "(2) ") + NEITHER.format("(3) ", "the Example Foundation, Ltd."), ["BSD-3-Clause"]),
        3: (BSD.format("a) ", "b) ") + NEITHER.format("c) ", "the University"), ["BSD-3-Clause"]),
        4: (BSD.format("1. ", "2. "), ["BSD-2-Clause"]),
        5: (BSD.format("1. ", "2. ") + "3. All advertising materials mentioning features or use of this software must display the"
            " following acknowledgement:\nThis product has parts of X.\n" + NEITHER.format("4. ", "J. Doe"), ["BSD-4-Clause"]),
        6: (BSD.format("1. ", "2. ") + "3. The name of the author may not be used to endorse or promote products\nderived from"
            " this software without specific prior written permission.", ["BSD-3-Clause"]),
        7: ("This file is licensed\n\nReleased under\nthe MIT License\n\nimport os\nx = 1", ["MIT"]),
        8: (GNU.format("library", "Lesser ", later.format("2.1")), ["LGPL-2.1-or-later"]),
        9: (GNU.format("program", "Affero ", later.format("3")), ["AGPL-3.0-or-later"]),
        10: (GNU.format("program", "", "version 2 of the License."), ["GPL-2.0-only"]), 11: (linux, ["GPL-2.0-only"]),
        12: ("Licensed under the GNU Lesser General Public License version 3\nor any later version.", ["LGPL-3.0-or-later"]),
        13: (GNU.format("program", "", later.format("2")), ["GPL-2.0-or-later"]),
        14: ("Neither the name of the firm nor the names of its staff matter. Linux is free software.", []),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id bigint, text string")
    df = df.unionByName(df.selectExpr("doc_id + 100 AS doc_id", r"replace(text, '\n', '\r\n') AS text"))
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(df).collect()}
    assert got == {k + more: w for k, (_, w) in cases.items() for more in (0, 100)}


# Operator 7

@pytest.mark.parametrize(("groups", "worse"), [(8, 1.2), (64, 1.03)])  # rounding costs less the more groups there are
def test_plan(groups, worse):
    for seed in range(25):
        rng = random.Random(seed)
        counts = collections.Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 12), 40]) for _ in range(rng.randrange(300)))
        held, got = collections.defaultdict(list), collections.Counter()
        ranks = collections.defaultdict(set)
        for length, rank, count, first, offset in packing.plan(counts, 64, groups, 12):
            got[length] += count
            ranks[length].update(range(rank, rank + count))
            for k in range(count):
                held[first + k].append((offset, length))
        assert got == counts and all(ranks[x] == set(range(n)) for x, n in counts.items())
        for of in held.values():
            end = 0
            for offset, length in sorted(of):
                assert offset == end
                end += length
            assert end <= 64
        rooms = []  # first fit, longest first: what a plain packing of the same pieces needs
        for length in sorted(counts.elements(), reverse=True):
            at = next((k for k, room in enumerate(rooms) if room >= length), None)
            if at is None:
                rooms.append(64 - length)
            else:
                rooms[at] -= length
        assert len(held) <= worse * len(rooms) + 1


def test_packing(spark, docs, table):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(PATH)
    slow.encode_special_tokens = True
    rows = packing.pack(docs, PATH, capacity=64).collect()
    want = collections.Counter()
    for key, text in table:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for piece, (start, length) in enumerate(packing.pieces_of(len(ids), 64)):
            assert length == 64 or piece == 0
            want[key, piece, start, length, zlib.crc32(ids[start:start + length].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for of in held.values():
        assert [o for o, _ in sorted(of)] == [0, *np.cumsum([n for _, n in sorted(of)])[:-1]] and sum(n for _, n in of) <= 64
    assert packing.pack(empty(spark), PATH).count() == 0


def test_tokens_equal_the_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(PATH), packing.Tokens(PATH)
    slow.encode_special_tokens = True

    @settings(max_examples=300, deadline=None)
    @given(st.text())
    def same(text):
        assert fast.ids(text) == slow.encode(text, add_special_tokens=False).ids

    same()
    for text in ("<|endoftext|> it's  \n\n 12,5 é中😀", "y" * 5000, " " * 5000 + "x", "　  a\tb"):
        assert fast.ids(text) == slow.encode(text, add_special_tokens=False).ids


def test_added_tokens_as_the_library_by_default(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(PATH)
    rows = [(1, "<|endoftext|>"), (2, "before <|endoftext|> after, it's 12"), (3, "x<|endoftext|><|endoftext|>\n"), (4, "<|endoftext |>")]
    want = {k: [*slow.encode(t, add_special_tokens=False).ids, 2] for k, t in rows}
    assert len(want[1]) == 2
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, capacity=64).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {
        k: (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for k, ids in want.items()}


# Operator 8

def test_chat(spark):
    texts = ["", None, "plain", "</s>[INST] ok [/INST]", "[\\INST] \\ [\\\\/INST]", "<", "[", "<<SYS>>x<</SYS>>", "\\", "<\\s>",
             "[TURN a]b[/TURN]", "[TURN %zz]", "a\n[/INST", "<s", "$1 \\1", "é😀 [INST]"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool 1%", None]), rng.choice(texts) if c % 2 else
             "".join(x or "" for x in rng.choices(texts, k=3))) for c in range(150) for t in range(rng.randrange(1, 6))]
    rows += [(None, 0, "user", "x"), (200, None, "user", "a"), (200, 0, "user", "b"), (200, 0, "assistant", "c"), (200, 0, "user", "b")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, output string")
    held = collections.defaultdict(list)
    for c, t, role, text in rows:
        held[c].append((-1 if t is None else t, role or "", text or ""))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(got) == set(held)
    for c, r in got.items():
        assert r.exact and [tuple(x) for x in r.turns] == [x[1:] for x in sorted(held[c])]
    assert chat.format_chats(df.limit(0)).count() == 0
    digests = {r.conv_id: r for r in chat.with_digests(chat.format_chats(df)).collect()}
    for c, r in digests.items():
        learned = "".join(x[2] for x in sorted(held[c]) if x[1] == "assistant")
        assert r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


# Operator 9

def test_line_dedup(spark, docs, table):
    blanks = " \t\n\x0b\x0c\r"
    owner = collections.defaultdict(set)
    key = lambda line: line.strip(blanks).translate(LOWER)
    for k, text in table:
        for line in (text or "").split("\n"):
            owner[key(line)].add(LAST if k is None else k)
    want = collections.Counter()
    for k, text in table:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(owner[key(x)]) == (LAST if k is None else k)]
        same = len(kept) == len(lines)
        want[k, len(lines), len(lines) - len(kept), text if same else "\n".join(kept)] += 1
    done = line_dedup.dedup_lines(docs)
    assert done.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in done.collect()) == want
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_across_slices(spark):
    """One line in all documents spans many slices; its first document is in one of them."""
    rows = [(k, "\n".join(["a line that all of them share", *[f"line {j} of document {k}" for j in range(130)]])) for k in range(60, 0, -1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(df).collect()} == {k: int(k > 1) for k, _ in rows}


# Operator 10

def test_sharding(spark, docs, table):
    placed = sharding.shard_rows(docs, shards=4, block_rows=5).collect()
    assert len(placed) == len(table)
    for shard in range(4):
        slots = sorted(r.slot for r in placed if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (len(table) // 4, len(table) // 4 + 1)
    assert collections.Counter((r.doc_id, r.text) for r in placed) == collections.Counter(table)
    assert sharding.shard_rows(empty(spark)).count() == 0


def test_matrix():
    for seed in range(20):
        rng = random.Random(seed)
        counts = [rng.randrange(40) for _ in range(rng.randrange(1, 9))]
        sizes = [n for of in sharding.block_sizes(sum(counts), 8, 6) for n in of]
        matrix = sharding.communication_matrix(counts, sizes, seed)
        assert matrix.sum(axis=1).tolist() == counts and matrix.sum(axis=0).tolist() == sizes and (matrix >= 0).all()


def test_placement_is_uniform():
    """Of 2 x 3 rows into shards of 3: how many of the first partition go to the first shard."""
    seen = collections.Counter(int(sharding.communication_matrix([3, 3], [3, 3], s)[0, 0]) for s in range(4000))
    assert all(abs(seen[k] / 4000 - w / 20) < 0.03 for k, w in enumerate([1, 9, 9, 1]))
    draw = np.random.Generator(np.random.PCG64(1))
    large = [sharding.hypergeometric(draw, 10**10, 3 * 10**10, 4000) for _ in range(300)]
    assert abs(np.mean(large) - 1000) < 10 and 20 < np.std(large) < 35
