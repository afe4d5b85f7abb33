"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of two blocks of words, one block apart. Their features are
the words of the benchmark, weighted by how few of all documents hold them. A
singular value decomposition of all items of a block gives the latent space: what
a passage has outside the items' span says nothing about any of them, so no
document is needed to fit it and none is sampled. All passages of all texts are
projected into it, and those with a cosine above a bound are candidates for an
item. A candidate is checked at all places near it: the longest common
subsequence decides about copies, and for paraphrases, which keep less, the
item's answer, its last words, must be there as well.

The benchmark is the stated query set. It is taken in blocks of items, and each
block is searched in all documents without a shuffle of texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex.llm.common import read, texts

ITEMS = 1024  # items searched at once
BLOCK = 32  # words
MIN_COSINE = 0.3
MIN_MASS = 0.3  # of an item's weight, as far as a window can hold it
MIN_WORDS = 5
MIN_CHARS = 8
COPY = 0.7
PARAPHRASE, ANSWER = 0.5, 0.75

WORD = re.compile(r"\w+")
_ASCII = {c: chr(c).lower() if WORD.match(chr(c)) else " " for c in range(128)}


def words_of(text: str) -> list[str]:
    """The runs of word characters in lower case. In plain ASCII every other character is a blank to split at."""
    return text.translate(_ASCII).split() if text.isascii() else WORD.findall(text.lower())


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence: one integer holds a column of the table."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@dataclass
class Benchmark:
    """A block of items: their words as numbers of a vocabulary that starts at 1, and the weights of those."""

    ids: list[int]
    items: list[list[int]]
    number: dict[str, int]
    weight: np.ndarray  # weight[0] = 0 stands for all other words
    basis: np.ndarray | None = None  # words x rank, weighted
    latent: np.ndarray | None = None  # items x rank, of length 1

    def search(self) -> Search:
        return Search(self)

    def numbers(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.number.get, words, repeat(0)), dtype=np.int32, count=len(words))


def _block_sums(numbers: np.ndarray, basis: np.ndarray, block: int) -> np.ndarray:
    """The sum of the basis rows of each block of words."""
    at = np.flatnonzero(numbers)
    out = np.zeros((-(-len(numbers) // block), basis.shape[1]), dtype=np.float32)
    if len(at):
        blocks = at // block
        first = np.flatnonzero(np.diff(blocks, prepend=-1))
        out[blocks[first]] = np.add.reduceat(basis[numbers[at]], first, axis=0)
    return out


def passages(numbers: np.ndarray, block: int = BLOCK, at_once: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """(first block, words) of up to ``at_once`` windows of two blocks; a text of one block is one window."""
    blocks = -(-len(numbers) // block)
    for begin in range(0, max(1, blocks - 1), at_once):
        yield begin, numbers[begin * block:(begin + at_once + 1) * block]


def window_sums(numbers: np.ndarray, basis: np.ndarray, block: int) -> np.ndarray:
    """The sum of the basis rows of each window of two blocks."""
    sums = _block_sums(numbers, basis, block)
    return sums[:-1] + sums[1:] if len(sums) > 1 else sums


def document_frequencies(docs: DataFrame, number: dict[str, int]) -> np.ndarray:
    """In how many texts each word of the vocabulary is; place 0 counts the texts. Over all texts."""
    size = len(number) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        known = number.keys()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts[0] += 1
                counts[[number[w] for w in known & set(words_of(text))]] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["w", "n"])

    out = np.zeros(size, dtype=np.int64)
    for w, n in docs.select("text").mapInArrow(counted, "w int, n bigint").groupBy("w").agg(F.sum("n")).collect():
        out[w] = n  # as many rows as the benchmark has words
    return out


def latent_space(bench: Benchmark) -> None:
    """Fit the space by a decomposition of all items, none of their span left out; sets the basis and the latent items."""
    size = len(bench.weight)
    matrix = np.zeros((len(bench.items), size), dtype=np.float32)
    for i, item in enumerate(bench.items):
        np.add.at(matrix[i], item, bench.weight[item])
    values, vectors = np.linalg.eigh((matrix @ matrix.T).astype(np.float64))
    kept = np.flatnonzero(values > 1e-6 * values[-1])[::-1]
    space = (matrix.T @ (vectors[:, kept] / np.sqrt(values[kept]))).astype(np.float32)
    bench.basis = space * bench.weight[:, None]
    latent = matrix @ space
    bench.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)


def check(item: list[int], numbers: np.ndarray, begin: int, end: int, holds: np.ndarray) -> tuple[float, bool, int]:
    """(share of the item in the longest common subsequence, is its answer there, first word) near a passage.

    The best of all spans of about 1.25 item lengths that meet the passage: one that is a find before one that is
    not, then the largest share, then the last. ``holds`` has what each word of the vocabulary weighs in the item.
    A span cannot share more words than it has of the item, each at most as often as the item has it. Spans
    that could not be a find by this bound are the only ones left out.
    """
    size, need = len(item), PARAPHRASE * len(item)
    span = size + size // 4 + 2
    begin, end = max(0, begin - span), min(len(numbers), end + span)
    region = numbers[begin:end]
    at = np.flatnonzero(holds[region])  # the item's words; others are in no common subsequence
    none = 0.0, False, begin
    if len(at) < need:
        return none
    places, near = at.tolist(), region[at].tolist()
    if common_subsequence(item, near) < need:
        return none
    answer = item[-max(3, size // 4):]
    often = Counter(item)
    seen: dict[int, list[int]] = {}
    change = [0] * (len(near) + 1)  # of the bound, from the span that starts at one word to that at the next
    first = 0
    for k, w in enumerate(near):
        while places[first] <= places[k] - span:
            first += 1
        earlier = seen.setdefault(w, [])
        change[max(first, earlier[-often[w]] + 1) if len(earlier) >= often[w] else first] += 1
        change[k + 1] -= 1
        earlier.append(k)
    bounds = np.cumsum(change[:-1])
    best = (False, *none)
    for k in sorted(np.flatnonzero(bounds >= need).tolist(), key=lambda k: (-bounds[k], -k)):
        if best[0] and bounds[k] < best[1] * size:
            break
        held = near[k:bisect_left(places, places[k] + span)]
        share = common_subsequence(item, held) / size
        answered = share >= PARAPHRASE and common_subsequence(answer, held) >= ANSWER * len(answer)
        best = max(best, (share >= COPY or answered, share, answered, begin + places[k]),
                   key=lambda x: (x[0], x[1], x[3]))
    return best[1:]


class Search:
    """Looks for the items of a block in one text after the other."""

    def __init__(self, bench: Benchmark, min_cosine: float = MIN_COSINE, block: int = BLOCK):
        self.bench, self.min_cosine, self.block = bench, min_cosine, block
        # What each word weighs in each item; every word that an item has weighs something.
        self.holds = np.zeros((len(bench.items), len(bench.weight)), dtype=np.float32)
        for i, item in enumerate(bench.items):
            self.holds[i, item] = bench.weight[item]
        self.masses = np.ascontiguousarray(self.holds.T)
        lengths = np.array([len(item) for item in bench.items])
        self.least = MIN_MASS * self.holds.sum(axis=1) * np.minimum(1, 1.5 * block / lengths)

    def found(self, text: str) -> dict[int, tuple]:
        """(kind, share, cosine, first word) by item number: the best passage for each item found."""
        bench, block, best = self.bench, self.block, {}
        numbers = bench.numbers(text)
        for first, part in passages(numbers, block):
            heavy = window_sums(part, self.masses, block) >= self.least
            if not heavy.any():
                continue  # no window has the mass of any item, so its place in the latent space decides nothing
            vectors = window_sums(part, bench.basis, block)
            length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
            products = vectors @ bench.latent.T
            for p, i in zip(*np.nonzero((products >= self.min_cosine * np.maximum(length, 1e-12)) & heavy), strict=True):
                begin = (first + int(p)) * block
                share, answered, at = check(bench.items[i], numbers, begin, begin + 2 * block, self.holds[i])
                kind = "copy" if share >= COPY else "paraphrase" if share >= PARAPHRASE and answered else None
                if kind and (i not in best or share > best[i][1]):
                    best[i] = (kind, share, float(products[p, i] / length[p, 0]), at)
        return best


def plain_words(text: str) -> str:
    """The words of a text with one blank between them."""
    return " ".join(words_of(text))


class Verbatim:
    """Looks for items too short for a subsequence: their words as they are, one after the other.

    An item in a script that is written with blanks has to begin and end where words do. Exact, at all places,
    with one automaton for all items of a block.
    """

    UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

    def __init__(self, block: list[tuple[int, str]]):
        import ahocorasick

        self.held = [item for _, item in block]
        self.automaton = ahocorasick.Automaton()
        for i, (_, item) in enumerate(block):
            self.automaton.add_word(item, (*self.automaton.get(item, ()), i))
        self.automaton.make_automaton()

    def found(self, text: str) -> dict[int, tuple]:
        """(kind, share, cosine, first word) by item number: the first place of each item found."""
        plain, best = plain_words(text), {}
        for end, numbers in self.automaton.iter(plain):
            item = None
            for i in numbers:
                if i in best:
                    continue
                if item is None:
                    item = self.held[i]
                    begin = end + 1 - len(item)
                    whole = (begin == 0 or plain[begin - 1] == " ") and (end + 1 == len(plain) or plain[end + 1] == " ")
                    if not whole and not self.UNSPACED.search(item):
                        break
                best[i] = ("copy", 1.0, 1.0, plain.count(" ", 0, begin))
        return best


@dataclass
class ShortItems:
    """A block of (item id, its words)."""

    block: list[tuple[int, str]]

    @property
    def ids(self) -> list[int]:
        return [key for key, _ in self.block]

    def search(self) -> Verbatim:
        return Verbatim(self.block)


def find_items(docs: DataFrame, bench: Benchmark | ShortItems) -> DataFrame:
    """(doc_id, item_id, kind, share, cosine, first_word): the best passage of each document and item found."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, ids = bench.search(), bench.ids
        for batch in batches:
            rows = [(key, ids[i], *best)
                    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for i, best in search.found(text).items()]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=["doc_id", "item_id", "kind", "share", "cosine", "first_word"])

    return docs.mapInArrow(
        searched, "doc_id bigint, item_id bigint, kind string, share double, cosine double, first_word bigint")


def benchmark_blocks(plain: DataFrame, benchmark: DataFrame, items_at_once: int) -> Iterator[Benchmark | ShortItems]:
    """The query set, a block of items at a time: long ones fitted, short ones as they are."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(
        "item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text")
    block, short = [], []
    given = items.toLocalIterator()
    while True:
        item = next(given, None)
        words = words_of(item["text"]) if item is not None else []
        if len(words) >= MIN_WORDS:
            block.append((item["item_id"], words))
        elif sum(map(len, words)) >= MIN_CHARS:
            short.append((item["item_id"], " ".join(words)))
        if short and (item is None or len(short) == items_at_once):
            yield ShortItems(short)
            short = []
        if block and (item is None or len(block) == items_at_once):
            yield fitted(plain, block)
            block = []
        if item is None:
            return


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  items_at_once: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, kind, share, cosine, first_word) of every benchmark item found in a document.

    ``kind`` is ``copy`` or ``paraphrase``; ``share`` is the part of the item's
    words in the longest common subsequence; ``first_word`` the word number.

    A null or empty text holds nothing. Items of fewer than five words, as whole sentences in scripts
    without blanks are, are found where all their words stand as they are, and are copies. Items without
    an id or of fewer than ``MIN_CHARS`` letters and digits in all say nothing and are passed over; an item that
    is given twice with different texts is searched under its id for both. Rows
    that repeat an id are searched each for itself; the best find of an id
    counts. An empty table on either side gives none.
    """
    plain = texts(docs, id_column, text_column)
    found = docs.sparkSession.createDataFrame(
        [], "doc_id bigint, item_id bigint, kind string, share double, cosine double, first_word bigint")
    for bench in benchmark_blocks(plain, benchmark, items_at_once):
        found = found.unionByName(find_items(plain, bench))
    return found.groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("kind", "share", "cosine", "first_word"), F.struct("share", "first_word")).alias("m")).select(
        "doc_id", "item_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          items_at_once: int = ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item; they pass through one filter per block.

    Items are those of ``contamination``. Rows with a null or empty text stay, rows that repeat an id are judged each by
    its own text, and other columns may have any names. An empty benchmark leaves all rows, an empty table none.
    """
    at, out = docs.columns.index(text_column), docs
    for bench in benchmark_blocks(texts(docs, id_column, text_column), benchmark, items_at_once):

        def kept(batches: Iterator[pa.RecordBatch], bench: Benchmark | ShortItems = bench) -> Iterator[pa.RecordBatch]:
            search = bench.search()
            for batch in batches:
                keep = [not search.found(t or "") for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(kept, docs.schema)
    return out


def fitted(plain: DataFrame, block: list[tuple[int, list[str]]]) -> Benchmark:
    number = {w: n for n, w in enumerate(sorted({w for _, words in block for w in words}), start=1)}
    counts = document_frequencies(plain, number)
    weight = np.log((counts[0] + 1) / (counts + 1)).astype(np.float32) + np.float32(0.05)
    weight[0] = 0
    bench = Benchmark([i for i, _ in block], [[number[w] for w in words] for _, words in block], number, weight)
    latent_space(bench)
    return bench


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"))

