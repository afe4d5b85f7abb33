"""Licence recognition by sentence rules.

A text is cut twice: into lines, and into sentences across wrapped lines. Each
unit is normalised, and known licence sentences are found in it between the
starts and ends of its lines; some have open slots for names. What remains is
a short sequence of sentence identifiers in text order, with a break where more
than ``MAX_GAP`` other units lie between. Ordered rules are matched against
these sequences. All steps are expressions inside the row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex.llm.common import read

MAX_GAP = 4

# Sentences of public licence texts and notices, normalised (lower case, letters, digits and
# inner dots, single blanks). The number is the sentence identifier.
SENTENCES = {
    10: "licensed under the apache license version 2.0",
    11: "licensed under the apache license version 2.0 the license",
    12: "you may not use this file except in compliance with the license",
    13: "you may obtain a copy of the license at http www.apache.org licenses license 2.0 unless required by"
        " applicable law or agreed to in writing software distributed under the license is distributed on an as is"
        " basis without warranties or conditions of any kind either express or implied",
    14: "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    15: "unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind either express or implied",
    16: "see the license for the specific language governing permissions and limitations under the license",
    17: "you may obtain a copy of the license at",
    20: "released under the mit license",
    21: "licensed under the mit license",
    22: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation"
        " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to"
        " permit persons to whom the software is furnished to do so subject to the following conditions",
    23: "the above copyright notice and this permission notice shall be included in all copies or substantial"
        " portions of the software",
    24: "the software is provided as is without warranty of any kind express or implied including but not limited to"
        " the warranties of merchantability fitness for a particular purpose and noninfringement",
    25: "in no event shall the authors or copyright holders be liable for any claim damages or other liability"
        " whether in an action of contract tort or otherwise arising from out of or in connection with the software"
        " or the use or other dealings in the software",
    30: "this work is licensed under the gnu general public license version 3",
    31: "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation either version 3 of the license or at your"
        " option any later version",
    32: "this program is free software",
    33: "you can redistribute it and or modify it under the terms of the gnu general public license as published by"
        " the free software foundation either version 3 of the license or at your option any later version",
    34: "this program is distributed in the hope that it will be useful but without any warranty",
    35: "without even the implied warranty of merchantability or fitness for a particular purpose",
    36: "see the gnu general public license for more details",
    37: "either version 2 of the license or at your option any later version",
    38: "you can redistribute it and or modify it under the terms of the gnu general public license as published by"
        " the free software foundation",
    39: "licensed under the gnu general public license version 2",
    40: "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met",
    41: "redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer",
    42: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
        " following disclaimer in the documentation and or other materials provided with the distribution",
    43: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission",
    44: "licensed under the bsd 3 clause license",
    45: "licensed under the bsd 2 clause license",
    50: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies",
    51: "licensed under the isc license",
    60: "this source code form is subject to the terms of the mozilla public license v 2.0",
    61: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    62: "you can obtain one at http mozilla.org mpl 2.0",
    70: "licensed under cc by nc 4.0",
    71: "licensed under cc by 4.0",
    72: "licensed under cc by sa 4.0",
    73: "this work is licensed under a creative commons attribution 4.0 international license",
    74: "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    75: "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    63: "mozilla public license version 2.0",
    64: "mozilla public license version 1.1",
    65: "the contents of this file are subject to the mozilla public license version 1.1 the license",
    77: "cc0 1.0 universal",
    78: "for these and or other purposes and motivations and without any expectation of additional consideration or"
        " compensation the person associating cc0 with a work the affirmer to the extent that he or she is an owner of"
        " copyright and related rights in the work voluntarily elects to apply cc0 to the work and publicly distribute the"
        " work under its terms with knowledge of his or her copyright and related rights in the work and the meaning and"
        " intended legal effect of cc0 on those rights",
    76: "to the extent possible under law the author s have dedicated all copyright and related and neighboring"
        " rights to this software to the public domain worldwide",
    80: "this is free and unencumbered software released into the public domain",
    90: "all rights reserved",
    # Titles of whole licence texts.
    180: "apache license version 2.0 january 2004",
    181: "gnu general public license version 2 june 1991",
    182: "gnu general public license version 3 29 june 2007",
    183: "gnu library general public license version 2 june 1991",
    184: "gnu lesser general public license version 2.1 february 1999",
    185: "gnu lesser general public license version 3 29 june 2007",
    186: "gnu affero general public license version 3 19 november 2007",
    190: "how to apply these terms to your new programs",
    191: "how to apply these terms to your new libraries",
}
APPENDIX = (190, 191)  # below them stands a notice as an example
APPENDIX_UNITS = 60  # lines, and more than enough for sentences
# Sentences with open slots as anchored patterns, (pattern, sentence identifier).
SLOT = r"(?:[a-z0-9.]++ ){1,20}?"  # a name
ENDORSE = r"be used to endorse or promote products derived from this software without (?:specific )?(?:prior )?(?:written )?permission"
SLOTS = [
    (rf"{SLOT}licenses this file to you under the apache license version 2.0 the license", 11),
    (rf"in no event shall {SLOT}be liable for any claim damages or other liability whether in an action of contract tort or"
     r" otherwise arising from out of or in connection with the software or the use or other dealings in the software", 25),
    (r"you may obtain a copy of the license at https www.apache.org licenses license 2.0", 14),
    (r"if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0", 61),
    (r"you can obtain one at https mozilla.org mpl 2.0", 62),
    (rf"{SLOT}is free software", 32),
    (r"(?:this|the) (?:program|library|software|file) is distributed in the hope that it will be useful but without any warranty", 34),
    (r"see the gnu (?:lesser |library |affero )?general public license for more details", 36),
    (rf"neither the names? of {SLOT}nor the names? of {SLOT}may {ENDORSE}(?: of {SLOT}[a-z0-9.]++)?", 43),
    (rf"the names? of {SLOT}may not {ENDORSE}", 46),
    (r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 47),
]
# The GNU licences from 200: one sentence for each family, version and "or later" or not, with and without "is free software".
FAMILIES = {"GPL": ("", ["2.0", "3.0"]), "LGPL": ("(?:lesser|library) ", ["2.0", "2.1", "3.0"]), "AGPL": ("affero ", ["3.0"])}
FSF = "as published by the free software foundation"
LATER = "or (?:at your option )?any later version"
ONLY: set[int] = set()  # identifiers that the rest of a wrapped sentence may still turn into "or later"


def gnu_rules() -> list[tuple[str, str, list[int]]]:
    """Adds the sentences of the GNU licences to SLOTS and gives their rules."""
    given = {("JL", "GPL", "3.0"): 31, ("PL", "GPL", "3.0"): 33, ("P", "GPL", ""): 38, ("EV", "", "2.0"): 37, ("NO", "GPL", "2.0"): 39}
    numbers: dict[tuple[str, str, str], int] = {}
    terms = "you (?:can|may) redistribute it and or modify it under the terms of "

    def sentence(pattern: str, *key: str) -> int:
        if key not in numbers:
            numbers[key] = given.get(key, 200 + len(numbers))
            SLOTS.append((pattern, numbers[key]))
            if key[0] in ("JO", "PO", "NO", "OV"):
                ONLY.add(numbers[key])
        return numbers[key]

    rules = []
    for family, (word, versions) in FAMILIES.items():
        name = f"gnu {word}general public license"
        joined = rf"{SLOT}is free software "
        for version in versions:
            v = version.removesuffix(".0") + (r"(?:\.0)?" if version.endswith(".0") else "")
            later = rf"the {name} (?:{FSF} )?(?:either )?(?:version |v){v} (?:of the license )?{LATER}"
            only = (rf"(?:the {name} (?:{FSF} )?(?:version |v){v}(?: only)?(?: of the license)?(?: only)?(?: {FSF})?"
                    rf"|version {v} of the {name}(?: {FSF})?)")
            ends = {"L": sentence(rf"(?:either )?version {v} of the license {LATER}", "EV", "", version),
                    "O": sentence(rf"version {v} of the license(?: only)?", "OV", "", version)}
            bare = [[sentence(joined + terms + f"the {name} {FSF}", "J", family, "")],
                    [32, sentence(terms + f"the {name} {FSF}", "P", family, "")]]
            for end, pattern, label in (("L", later, "or-later"), ("O", only, "only")):
                licence = f"{family}-{version}-{label}"
                notice = r"(?:this (?:work|program|library|software|file|project) is )?licensed under (?:the terms of )?"
                rules += [(licence, "header", [*b, ends[end]]) for b in bare]
                rules += [(licence, "notice", [sentence(joined + terms + pattern, "J" + end, family, version)]),
                          (licence, "notice", [32, sentence(terms + pattern, "P" + end, family, version)]),
                          (licence, "notice", [sentence(notice + pattern, "N" + end, family, version)])]
    return rules


# SPDX tags as sentences, numbered from 100 in this order.
SPDX = ["Apache-2.0", "MIT", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "BSD-3-Clause",
        "BSD-2-Clause", "ISC", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense",
        "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
        "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-4-Clause"]
COPYRIGHT = 1
# (licence, kind, ordered sentence identifiers); a later rule of the same licence is less specific.
RULES = [
    ("Apache-2.0", "header", [11, 12, 13, 16]), ("Apache-2.0", "header", [11, 12, 14, 15, 16]),
    ("Apache-2.0", "header", [11, 12, 17, 16]), ("Apache-2.0", "notice", [11, 12]), ("Apache-2.0", "notice", [10]),
    ("MIT", "text", [22, 23, 24, 25]), ("MIT", "text", [22, 23]), ("MIT", "notice", [20]), ("MIT", "notice", [21]),
    ("GPL-3.0-or-later", "header", [31, 34, 35, 36]), ("GPL-3.0-or-later", "header", [32, 33, 34, 36]),
    ("GPL-3.0-or-later", "notice", [31]), ("GPL-3.0-or-later", "notice", [32, 33]), ("GPL-3.0-only", "notice", [30]),
    ("GPL-2.0-or-later", "header", [32, 38, 37]), ("GPL-2.0-only", "notice", [39]),
    ("BSD-3-Clause", "text", [40, 41, 42, 43]), ("BSD-2-Clause", "text", [40, 41, 42]),
    ("BSD-3-Clause", "notice", [44]), ("BSD-2-Clause", "notice", [45]),
    ("ISC", "text", [50]), ("ISC", "notice", [51]),
    ("MPL-2.0", "header", [60, 61]), ("MPL-2.0", "header", [60, 62]), ("MPL-2.0", "notice", [60]),
    ("CC-BY-NC-4.0", "notice", [70]), ("CC-BY-NC-4.0", "notice", [75]), ("CC-BY-4.0", "notice", [71]),
    ("CC-BY-4.0", "notice", [73]), ("CC-BY-SA-4.0", "notice", [72]), ("CC-BY-SA-4.0", "notice", [74]),
    ("CC0-1.0", "notice", [76]), ("CC0-1.0", "text", [78]), ("CC0-1.0", "title", [77]),
    ("MPL-2.0", "title", [63]), ("MPL-1.1", "header", [65, 12]), ("MPL-1.1", "notice", [65]), ("MPL-1.1", "title", [64]),
    ("Apache-2.0", "title", [180]), ("GPL-2.0", "title", [181]), ("GPL-3.0", "title", [182]), ("LGPL-2.0", "title", [183]),
    ("LGPL-2.1", "title", [184]), ("LGPL-3.0", "title", [185]), ("AGPL-3.0", "title", [186]), ("Unlicense", "text", [80]),
    ("Proprietary", "notice", [1, 90]), ("Proprietary", "notice", [90]),
    *[(name, "tag", [100 + i]) for i, name in enumerate(SPDX)],
    ("BSD-3-Clause", "text", [40, 41, 42, 46]),
    ("BSD-4-Clause", "text", [40, 41, 42, 47, 43]), ("BSD-4-Clause", "text", [40, 41, 42, 47, 46]),
]
RULES += [rule for rule in gnu_rules() if rule not in RULES and (rule[0], "notice", rule[2]) not in RULES]
# A licence whose rule is part of another licence's rule goes if the other is found.
PART_OF = [("BSD-2-Clause", "BSD-3-Clause"), ("BSD-2-Clause", "BSD-4-Clause"), ("BSD-3-Clause", "BSD-4-Clause")]
# The text of a GNU licence by itself does not say whether later versions may be chosen; a notice beside it does.
PART_OF += [(f"{family}-{v}", f"{family}-{v}-{end}") for family, (_, versions) in FAMILIES.items()
            for v in versions for end in ("only", "or-later")]
# Each known sentence has one of these words.
TELLING = r"(?i)licen[sc]e|copyright|permission|redistribut|software|warrant|reserved|mozilla|endorse|how to apply|\bcc0?\b"


JOINT = "\x01"  # stands for a line end inside a sentence


def normalised(unit: Column) -> Column:
    """Lower case, one spelling, single blanks between runs of letters, digits and inner dots; no list marks at line starts.

    Line ends inside a sentence stay.
    """
    marked = F.regexp_replace(
        F.lower(unit), rf"(^|{JOINT})[^a-z0-9{JOINT}]*+(?:[0-9]{{1,2}}|[a-z]|[ivx]{{1,4}})[.)\]]++[ \t]++", "$1")
    words = F.regexp_replace(marked, rf"[^a-z0-9.{JOINT}]+|\.(?![a-z0-9])|(?<![a-z0-9])\.", " ")
    lines = F.regexp_replace(F.regexp_replace(words, " +", " "), rf" ?{JOINT}[ {JOINT}]*+", JOINT)
    return F.regexp_replace(F.btrim(lines, F.lit(" " + JOINT)), r"\blicence", "license")


def sentence_number(unit: Column) -> Column:
    """The identifier of a normalised licence sentence on one line; 0 if it is none."""
    known = [(text, n) for n, text in SENTENCES.items()]
    known += [("spdx license identifier " + spoken(name), 100 + i) for i, name in enumerate(SPDX)]
    table = F.create_map(*[F.lit(x) for text, n in known for x in (text, n)])
    slots = F.lit(0)
    for pattern, n in reversed(SLOTS):
        slots = F.when(unit.rlike(f"^(?:{pattern})$"), n).otherwise(slots)
    return F.when(unit.startswith("copyright ") & unit.rlike(r"^copyright (c )?(19|20)\d\d"), COPYRIGHT).otherwise(
        F.coalesce(F.try_element_at(table, unit), slots))


def any_sentence() -> str:
    """A pattern of all known sentences from the start of a line to the end of one, longer ones first."""
    plain = [*SENTENCES.values(), *["spdx license identifier " + spoken(name) for name in SPDX]]
    fixed = [text.replace(".", r"\.") for text in sorted(plain, key=lambda t: -len(t))]
    open_ones = [pattern + (r"(?! or\b)" if n in ONLY else "") for pattern, n in sorted(SLOTS, key=lambda x: -len(x[0]))]
    every = "|".join([*open_ones, *fixed]).replace(" ", f"[ {JOINT}]")
    return rf"(?:^|{JOINT})((?:{every}|copyright[ {JOINT}](?:c[ {JOINT}])?(?:19|20)\d\d[^{JOINT}]*+)(?={JOINT}|$))"


def spoken(name: str) -> str:
    """An SPDX name as ``normalised`` leaves it."""
    return name.lower().replace("-", " ")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def sentences_of(text: Column) -> Column:
    """Sentences across line ends; comment marks at the start of lines are no part of them."""
    joined = F.regexp_replace(text, r"\n[ \t]*(?:[/*#;%]+[ \t]*)?", JOINT)
    gap = rf"[ \t\r{JOINT}]++"
    end = rf"(?<=[.;:!?])(?<!\bv\.){gap}"
    # A full stop may belong to a name in a slot: "the name of Example Inc. nor ...".
    open_slot = (rf"(?!(?i:(?:(?!neither\b|the{gap}names?{gap}of\b)[^;:!?]){{0,150}}?"
                 rf"\b(?:nor{gap}the{gap}names?\b|may{gap}not{gap}be{gap}used{gap}to{gap}endorse)))")
    return F.when(joined.rlike("(?i)endorse"), F.split(joined, end + open_slot, -1)).otherwise(F.split(joined, end, -1))


def known_units(units: Column, lines: bool = False) -> Column:
    """array<struct<at, id>> of the licence sentences in the units, in order.

    They may stand above or below lines without an end mark, such as code. A line by itself does not show
    whether "or later" follows in the next; the sentences do.
    """
    long_enough = F.filter(F.transform(units, lambda u, i: F.struct(i.alias("at"), u.alias("unit"))),
                           lambda x: (F.char_length(x["unit"]) >= 10) & x["unit"].rlike(TELLING))
    numbered = F.flatten(F.transform(long_enough, lambda x: F.transform(
        F.regexp_extract_all(normalised(x["unit"]), F.lit(any_sentence()), 1), lambda found: F.struct(
            x["at"].alias("at"), sentence_number(F.translate(found, JOINT, " ")).alias("id")))))
    unsure = sorted(ONLY - set(SENTENCES)) if lines else []
    known = F.filter(numbered, lambda x: (x["id"] > 0) & ~x["id"].isin(unsure) if unsure else x["id"] > 0)
    # Held in an array of one, so that the sentences are found once although three expressions read them.
    return F.get(F.transform(F.array(known), lambda found: F.when(
        F.exists(found, lambda x: x["id"].isin(*APPENDIX)), without_examples(found)).otherwise(found)), 0)


def without_examples(known: Column) -> Column:
    """Without the notices of the GNU licences that the appendix of such a licence shows as an example."""
    shown = F.transform(F.filter(known, lambda x: x["id"].isin(*APPENDIX)), lambda x: x["at"])
    return F.filter(known, lambda x: ~(
        (x["id"].between(30, 39) | (x["id"] >= 200))
        & F.exists(shown, lambda at: (x["at"] >= at) & (x["at"] - at <= APPENDIX_UNITS))))


def sequence_text(known: Column, max_gap: int = MAX_GAP) -> Column:
    """Identifiers in order: ``,`` before one that follows closely, ``;`` before one that does not."""
    return F.array_join(F.transform(known, lambda x, i: F.concat(
        F.when((i > 0) & (x["at"] - F.get(known, i - 1)["at"] <= max_gap + 1), ",").otherwise(";"),
        x["id"].cast("string"))), "")


def rule_pattern(ids: list[int]) -> str:
    """Identifiers in this order; other known sentences may lie between, a break may not."""
    return "[;,]" + r"(?:,\d+)*?,".join(map(str, ids)) + r"(?!\d)"


def reserved_alone(sequence: Column) -> Column:
    """Does "all rights reserved" stand in a run of sentences without a licence?"""
    reserved = rule_pattern([90])
    other = "|".join(rule_pattern(ids) for name, _, ids in RULES if name != "Proprietary")
    return F.when(sequence.rlike(reserved), F.exists(
        F.transform(F.split(sequence, ";"), lambda run: F.concat(F.lit(";"), run)),
        lambda run: run.rlike(reserved) & ~run.rlike(other))).otherwise(F.lit(False))


def matched_rules(lines: Column, sentences: Column) -> Column:
    """Numbers of the rules that match one of the sequences, the most specific of each licence only."""
    by_licence: dict[str, list[int]] = {}
    for i, (name, _, _) in enumerate(RULES):
        by_licence.setdefault(name, []).append(i)
    found = []
    for rules in by_licence.values():
        rules = sorted(rules, key=lambda i: -len(RULES[i][2]))
        pick = F.lit(None).cast("int")
        for i in reversed(rules):
            pattern = rule_pattern(RULES[i][2])
            pick = F.when(lines.rlike(pattern) | sentences.rlike(pattern), i).otherwise(pick)
        if RULES[rules[0]][0] == "Proprietary":
            # Sentences reach across lines and see a licence that lines do not, so theirs is the say where they have it.
            alone = F.when(sentences.rlike(rule_pattern([90])), reserved_alone(sentences)).otherwise(reserved_alone(lines))
            pick = F.when(alone, pick)
        found.append(pick)
    return F.when((lines == "") & (sentences == ""), F.array().cast("array<int>")).otherwise(F.array_compact(F.array(*found)))


def scan_licenses(docs: DataFrame, text_column: str = "text", max_gap: int = MAX_GAP) -> DataFrame:
    """All columns of ``docs`` plus ``licenses``, ``rules``, ``line_ids`` and ``sentence_ids``.

    ``licenses`` is the sorted array of licence names, ``rules`` an array of
    (license, kind, length) of the rules that matched, ``line_ids`` and
    ``sentence_ids`` hold (unit number, sentence identifier) of each known unit.

    A null or empty text has none. Each row is scanned by itself, so repeated
    rows and null ids need no rule. Columns of these four names are replaced. An
    empty table gives none.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    names = ("licenses", "rules", "line_ids", "sentence_ids")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    table = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(k).alias("kind"), F.lit(len(ids)).alias("length"))
                      for n, k, ids in RULES])
    scanned = (
        kept.withColumn("line_ids", known_units(lines_of(text), lines=True))
        .withColumn("sentence_ids", known_units(sentences_of(text)))
        .withColumn("_lines", sequence_text(F.col("line_ids"), max_gap))
        .withColumn("_sentences", sequence_text(F.col("sentence_ids"), max_gap))
        .withColumn("rules", F.transform(
            F.array_sort(matched_rules(F.col("_lines"), F.col("_sentences"))), lambda i: F.get(table, i)))
        .drop("_lines", "_sentences")
        .withColumn("licenses", F.array_sort(F.array_distinct(F.transform("rules", lambda r: r["license"]))))
    )
    for part, whole in PART_OF:
        scanned = scanned.withColumn("licenses", F.when(
            F.array_contains("licenses", whole), F.array_remove("licenses", part)).otherwise(F.col("licenses")))
    return scanned


def op6_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    pairs = lambda name: F.array_join(F.transform(name, lambda x: F.concat_ws(":", x["at"], x["id"])), ",")
    return scan_licenses(read(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"),
        F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["license"], r["kind"], r["length"])), ",").alias("rules"),
        pairs("line_ids").alias("line_ids"), pairs("sentence_ids").alias("sentence_ids"))
