"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, compatibility forms, accents, look-alike
letters of other scripts and digits that stand for letters inside words. The
lexicon holds whole words and beginnings of words with their log-odds, learned
from labelled texts and kept only if the evidence would not be expected by
chance among that many candidates. One Aho-Corasick pass over the folded text
finds all terms and the exception phrases, inside which terms do not count. The
weights of the words hit, divided by the length, give a density, and a logistic
curve fitted on the labelled texts, each with its own contribution to the
lexicon left out, turns it into a score.

Only the fit is bounded: it takes at most ``max_labelled`` labelled texts. All
texts are scored in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex.llm.common import read, texts
from termindex.session import settled

MAX_LABELLED = 24_000
MAX_TERMS = 20_000
PREFIXES = (4, 5, 6, 7)
MIN_SUPPORT = 3
SMOOTHING = 20  # words added to a length, so that one hit in a very short text is not everything
THRESHOLD = 0.7
# Letters that look like Latin ones, digits and signs used for letters.
LOOKALIKES = str.maketrans(
    "абвгеёзийкмнорстухьіїјѕԁԛԝһαβγδεζηικμνορτυχωıłøđßæœ",
    "abbreeзиikmhopctyxbiijsdqwhabydeznikmvoptuxwiłodsæœ")
DIGITS = str.maketrans("0134578@$!|", "oieastbasii")
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "trash collection", "clown fish", "pathetic fallacy",
              "not an idiot", "not a moron", "not a loser", "not stupid", "not worthless")

_SIGNS = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W\d_])")
_BREAKS = re.compile(r"[\W_]+")
_MIXED = re.compile(r"[^\W\d_]+\d\w*|\d+[^\W\d_]\w*")
_MARKS = re.compile("[̀-ͯ​-‏⁠﻿­]+")


def fold(text: str) -> str:
    """Words of folded letters with one blank before, between and behind them."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(LOOKALIKES)
    text = _SIGNS.sub(lambda m: m[0].translate(DIGITS), text)
    text = _BREAKS.sub(" ", text)
    text = _MIXED.sub(lambda m: m[0].translate(DIGITS), text)
    return f" {text.strip()} "


def candidates(word: str) -> list[str]:
    """The lexicon terms that a word would count for: `` word `` and `` beginning``."""
    return ([f" {word} "] if len(word) > 2 else []) + [f" {word[:n]}" for n in PREFIXES if len(word) > n]


@dataclass
class Lexicon:
    """Counts of labelled texts by term, and the curve; everything that scoring needs."""

    terms: dict[str, tuple[int, int]] = field(default_factory=dict)  # term -> toxic texts, other texts
    toxic: int = 0
    other: int = 0
    tests: int = 1  # how many candidates there were
    curve: tuple[float, float] = (0.0, 0.0)  # intercept and slope
    exceptions: tuple[str, ...] = EXCEPTIONS

    def weight(self, a: int, b: int, toxic: int, other: int) -> float:
        """Log-odds of a term found in ``a`` of the toxic and ``b`` of the other texts; 0 without evidence."""
        if a < MIN_SUPPORT - 1 or not other:
            return 0.0
        share = toxic / (toxic + other)
        gain = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0.0))
        if a <= (a + b) * share or gain < 2 * math.log(self.tests) + 2:
            return 0.0
        return math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1))

    def weights(self) -> dict[str, tuple[float, float, float]]:
        """Of each term: its weight, and without one toxic or one other text."""
        out = {}
        for term, (a, b) in self.terms.items():
            three = (self.weight(a, b, self.toxic, self.other),
                     self.weight(a - 1, b, self.toxic - 1, self.other),
                     self.weight(a, b - 1, self.toxic, self.other - 1) if b else 0.0)
            if any(three):
                out[term] = three
        return out


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for term, weights in lexicon.weights().items():
            self.automaton.add_word(term, (len(term), weights))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(told := fold(phrase), (len(told), None))
        self.automaton.make_automaton()

    def density(self, text: str, label: int | None = None) -> tuple[float, int, int]:
        """Weight per word, words hit, words. With a label the text's own share in the counts is left out."""
        folded = fold(text)
        which = 0 if label is None else 1 if label else 2
        hits: dict[int, float] = {}
        exempt: list[tuple[int, int]] = []
        for end, (length, weights) in self.automaton.iter(folded):
            begin = end - length + 1
            if weights is None:
                exempt.append((begin, end))
            elif weights[which] > hits.get(begin, 0.0):
                hits[begin] = weights[which]
        if exempt and hits:
            # One merge of two sorted lists: a hit goes if an exception that began up to it has not yet ended.
            exempt.sort()
            k, covered = 0, 0
            for at in sorted(hits):
                while k < len(exempt) and exempt[k][0] <= at:
                    covered = max(covered, exempt[k][1])
                    k += 1
                if at < covered:
                    del hits[at]
        words = folded.count(" ") - 1 if folded.strip() else 0
        return sum(hits.values()) / (words + SMOOTHING), len(hits), words

    def score(self, density: float) -> float:
        a, b = self.lexicon.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * feature(density)))))


def feature(density: float) -> float:
    return math.log1p(100 * density)


def fitted_curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through (feature, toxic, other) counts, by Newton's method.

    A weak prior of one text on either side keeps the curve finite where a cut
    separates the classes. The rarer class gets the geometric mean of its own
    weight and an equal one, so that neither misses nor false alarms dominate.
    """
    x = np.array([b[0] for b in bins] + [0.0, max(b[0] for b in bins)])
    toxic = np.array([b[1] for b in bins] + [0, 1], dtype=float)
    other = np.array([b[2] for b in bins] + [1, 0], dtype=float)
    toxic *= (other.sum() / toxic.sum()) ** 0.5
    ridge = 1e-3 * (toxic.sum() + other.sum())
    design = np.column_stack([np.ones_like(x), x])
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (toxic - (toxic + other) * p) - np.array([0, ridge * beta[1]]) * 0.01
        hess = (design * ((toxic + other) * p * (1 - p))[:, None]).T @ design + np.diag([1e-9, ridge * 0.01])
        step = np.linalg.solve(hess, grad)
        beta += step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS,
        exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn from the labelled texts that are not held out; of more than ``max_labelled``, those of the smallest hashes.

    ``docs`` is (doc_id, text), ``labels`` (doc_id, toxic). Labels without an id
    or a value are passed over; of several labels of an id the largest counts.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    train = settled(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic").repartition(32), "labelled")
    sums = train.agg(F.sum("toxic"), F.count("*")).first()
    lexicon = Lexicon(toxic=int(sums[0] or 0), other=int(sums[1] - (sums[0] or 0)), exceptions=exceptions)
    if not lexicon.toxic or not lexicon.other:
        lexicon.curve = (30.0 if lexicon.toxic else -30.0, 0.0)
        return lexicon

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {term for word in set(fold(text).split()) for term in candidates(word)}
                sums[1 if toxic else 0].update(found)
            if len(sums[0]) + len(sums[1]) > 1_000_000:
                yield from told(sums)
        yield from told(sums)

    def told(sums: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        for label, held in enumerate(sums):
            zeros = [0] * len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()) if label else zeros, pa.int64()),
                 pa.array(zeros if label else list(held.values()), pa.int64())], names=["term", "a", "b"])
            held.clear()

    terms = settled(
        train.mapInArrow(counted, "term string, a bigint, b bigint").groupBy("term")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") >= MIN_SUPPORT), "terms")
    lexicon.tests = max(1, terms.count())
    expected = F.col("a") / ((F.col("a") + F.col("b")) * (lexicon.toxic / (lexicon.toxic + lexicon.other)))
    best = terms.filter(expected > 1.5).orderBy(F.desc(F.col("a") * F.log(expected)), "term").limit(max_terms).collect()
    lexicon.terms = {r["term"]: (r["a"], r["b"]) for r in best}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            x = [round(feature(matcher.density(t, y)[0]), 2) for t, y in zip(batch.column(0).to_pylist(), labels, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(labels, pa.int32())], names=["x", "toxic"])

    bins = train.mapInArrow(placed, "x double, toxic int").groupBy("x").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).orderBy("x").collect()
    lexicon.curve = fitted_curve([(r["x"], r["a"], r["b"]) for r in bins])
    return lexicon


def score_texts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits, n_words) of each row of (doc_id, text)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            found = [matcher.density(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([matcher.score(d) for d, _, _ in found], pa.float64()),
                 pa.array([h for _, h, _ in found], pa.int64()), pa.array([w for _, _, w in found], pa.int64())],
                names=["doc_id", "score", "n_hits", "n_words"])

    return docs.mapInArrow(scored, "doc_id bigint, score double, n_hits bigint, n_words bigint").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_hits", "n_words")


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Score every row: fit on the labelled texts that are not held out, then one pass over all texts.

    A null or empty text has no hits and gets the score of that. Rows are scored
    one by one, so repeated rows get equal scores; rows without an id are never
    held out. Without labels, or with one class only, all scores are 0 or all 1.
    An empty table gives none. Only the id's checksum and the text are used.
    """
    plain = texts(docs, id_column, text_column)
    return score_texts(plain, fit(plain, labels, **options))


def accepted(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted to be toxic; they pass through one filter.

    A null text counts as an empty one. Rows that repeat an id, or have none, are judged each by its own text. Other columns
    may have any names. Without labels all rows stay; an empty table gives none.
    """
    lexicon = fit(texts(docs, id_column, text_column), labels, **options)
    at = docs.columns.index(text_column)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            keep = [matcher.score(matcher.density(t or "")[0]) < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(read(spark, sf, "documents"), read(spark, sf, "labels"))
