"""Best-fit packing of token sequences by a linear grouping scheme.

A plan depends on lengths only, and there are at most ``capacity`` of them. So
the documents are tokenised and cut once, their lengths counted, and the plan is
made from the counts: large lengths are sorted and rounded up to the largest of
their group, in groups of about equal cardinality. Configurations of these few
sizes are chosen, the fullest first, which is a basis of the linear program that
says how often each configuration is used; column generation improves it, at most
once for each size. Whole parts of its solution are taken, and the pieces left by
rounding down take the fullest configurations again. Actual lengths take the places
of the rounded ones, and small lengths go where they fit best. A plan is a list of
runs, (length, first rank, count, first sequence, offset). A piece finds its
place by its rank among the pieces of its length: the pieces of its length in
earlier partitions plus those before it in its own. No row leaves its place for
that, however many rows have one length.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termindex.llm.common import broadcast_if_small, read, texts
from termindex.llm.cutting_stock import generate
from termindex.session import settled

CAPACITY = 1024
END = 2
GROUPS = 512
SMALL = CAPACITY // 4  # lengths up to this are small
LONG_RUN = 2000


class Tokens:
    """Ids of a byte-level tokenizers file. With ``added``, a string of an added token in a text is that token, as in
    the library's default state, and such texts go to ``tokenizers``; without, it is ordinary text.

    The merges run in ``tiktoken``, with the vocabulary and the splitting pattern of the file, which gives the
    same ids several times faster; a text with an unusually long run without blanks goes to ``tokenizers``,
    whose time does not grow with the square of the run.
    """

    # Fixed value: how byte-level tokenizers cut a text.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str, added: bool = False):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = not added
        self.long_run = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"] for t in told["added_tokens"]}
        self.added = sorted(special) if added else []
        ranks = {bytes(byte_of[c] for c in word): n for word, n in told["model"]["vocab"].items() if word not in special}
        self.fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.long_run.search(text) or any(token in text for token in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces_of(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece: only the first may be shorter than the capacity."""
    first = length if length <= capacity else length % capacity or capacity
    return [(0, first)] + [(start, capacity) for start in range(first, length, capacity)]


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, id_column: str = "doc_id",
              text_column: str = "text") -> DataFrame:
    """(p, doc_id, piece, start, length, ids_crc32, nth): ``nth`` counts pieces of one length in partition ``p``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen, p = Tokens(path, added=True), Counter(), TaskContext.get().partitionId()
        names = ["p", "doc_id", "piece", "start", "length", "ids_crc32", "nth"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*tokens.ids(text.as_py()), END], dtype="<u4")
                for piece, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    crc = zlib.crc32(ids[start:start + length].tobytes())
                    rows.append((p, key, piece, start, length, crc, seen[length]))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return texts(docs, id_column, text_column).mapInArrow(
        run, "p int, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint")


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded length, [[length, count], ...]) in descending order, groups of about equal cardinality."""
    total, out, filled = sum(counts.values()), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            bound = -(-total * max(1, len(out)) // groups) if out else 0
            if not out or filled >= bound:
                out.append((length, []))
                bound = -(-total * len(out) // groups)
            take = min(left, max(1, bound - filled))
            out[-1][1].append([length, take])
            filled += take
            left -= take
    joined: list[tuple[int, list[list[int]]]] = []
    for size, runs in out:  # groups that round to one size are one size
        if joined and joined[-1][0] == size:
            joined[-1][1].extend(runs)
        else:
            joined.append((size, runs))
    return joined


def best_rest(room: int, sizes: np.ndarray, have: np.ndarray) -> list[int]:
    """Up to three sizes (indices) whose sum is the largest within ``room``; fewer ones on ties."""
    usable = np.flatnonzero((have > 0) & (sizes <= room))
    if not len(usable):
        return []
    s = sizes[usable]
    best, pick = int(s.max()), [int(usable[s.argmax()])]
    i, j = np.triu_indices(len(s))
    fits = (s[i] + s[j] <= room) & ((i != j) | (have[usable[i]] > 1))
    i, j = i[fits], j[fits]
    if not len(i):
        return pick
    pairs = s[i] + s[j]
    order = np.argsort(pairs, kind="stable")
    pairs, i, j = pairs[order], i[order], j[order]
    if pairs[-1] > best:
        best, pick = int(pairs[-1]), [int(usable[i[-1]]), int(usable[j[-1]])]
    at = np.searchsorted(pairs, room - s, side="right") - 1
    for third in np.argsort(-np.where(at >= 0, s + pairs[np.maximum(at, 0)], -1), kind="stable")[:8]:
        if at[third] < 0 or s[third] + pairs[at[third]] <= best:
            break
        chosen = Counter([int(usable[third]), int(usable[i[at[third]]]), int(usable[j[at[third]]])])
        if all(have[k] >= n for k, n in chosen.items()):
            best, pick = int(s[third] + pairs[at[third]]), list(chosen.elements())
    return pick


def fullest(sizes: np.ndarray, have: np.ndarray, capacity: int, whole: bool = True) -> Iterator[tuple[float, np.ndarray]]:
    """(times, configuration) that use all of ``have``: around the largest size left, each as often as it can be.

    Unless ``whole``, a configuration is used a fractional number of times, so each one uses up a size.
    """
    have = have.copy() if whole else have.astype(float)
    for k in range(len(sizes)):
        while have[k] > 0:
            others = have.copy() if whole else np.where(have > 0, capacity, 0)
            others[k] -= whole
            configuration = np.bincount([k, *best_rest(capacity - int(sizes[k]), sizes, others)], minlength=len(sizes))
            used = np.flatnonzero(configuration)
            often = have[used] // configuration[used] if whole else have[used] / configuration[used]
            times = often.min()
            have -= times * configuration
            have[used[often == times]] *= whole  # exactly used up, whatever the rounding errors
            yield times, configuration


def first_basis(sizes: np.ndarray, have: np.ndarray, capacity: int) -> np.ndarray:
    """The fullest configurations as a basis: each uses a size up that no later one has, so none depends on the others.

    A size that ends together with another has a configuration of itself alone.
    """
    left, columns, ended = have.astype(float), [], np.zeros(len(sizes), dtype=bool)
    for times, configuration in fullest(sizes, have, capacity, whole=False):
        used = np.flatnonzero((configuration > 0) & ~ended)
        over = used[left[used] / configuration[used] <= times]
        left -= times * configuration
        left[over], ended[over] = 0, True
        columns += [configuration] * bool(len(over)) + [*np.eye(len(sizes), dtype=int)[over[1:]]]
    columns += [*np.eye(len(sizes), dtype=int)[~ended]]  # only where rounding errors have used a size up
    return np.array(columns, dtype=float).T


class Plan:
    """Runs of equal sequences; all counts, no rows."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.rank: Counter = Counter()  # the next rank of each length
        self.placed: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, count)

    def put(self, length: int, first: int, count: int, room: int) -> None:
        self.placed.append((length, self.rank[length], count, first, self.capacity - room))
        self.rank[length] += count

    def configure(self, sizes: list[tuple[int, list[list[int]]]]) -> None:
        """Fill configurations of the rounded sizes and substitute the actual lengths."""
        if not sizes:
            return
        size = np.array([s for s, _ in sizes], dtype=np.int64)
        have = np.array([sum(n for _, n in runs) for _, runs in sizes], dtype=np.int64)
        runs = [[list(r) for r in of] for _, of in sizes]
        for often, configuration in generate(size, have.astype(float), self.capacity,
                                             start=first_basis(size, have, self.capacity), turns=len(size)):
            times = int(often + 1e-6)
            for k in np.flatnonzero(configuration):  # rounding errors of the program never take more than there is
                times = min(times, int(have[k]) // int(configuration[k]))
            if times:
                have -= times * configuration
                self._substitute(np.repeat(np.arange(len(size)), configuration).tolist(), runs, times)
        for times, configuration in fullest(size, have, self.capacity):
            self._substitute(np.repeat(np.arange(len(size)), configuration).tolist(), runs, int(times))

    def _substitute(self, slots: list[int], runs: list[list[list[int]]], times: int) -> None:
        # Take each slot's pieces first: slots of one group follow each other in its list.
        taken = []
        for slot in slots:
            need, parts = times, []
            while need:
                length, count = runs[slot][0]
                use = min(need, count)
                parts.append([length, use])
                need -= use
                if use == count:
                    runs[slot].pop(0)
                else:
                    runs[slot][0][1] -= use
            taken.append(parts)
        done = 0
        while done < times:  # sequences with the same actual lengths in all slots
            same = min(parts[0][1] for parts in taken)
            room = self.capacity
            for parts in taken:
                self.put(parts[0][0], self.sequences + done, same, room)
                room -= parts[0][0]
                parts[0][1] -= same
                if not parts[0][1]:
                    parts.pop(0)
            if room:
                self.open[room].append((self.sequences + done, same))
            done += same
        self.sequences += times

    def best_fit(self, length: int, count: int) -> None:
        """Each piece goes to a sequence with the least room that holds it."""
        while count:
            room = min((r for r, held in self.open.items() if r >= length and held), default=None)
            if room is None:
                room = self.capacity
                first, held = self.sequences, -(-count // (room // length))
                self.sequences += held
            else:
                first, held = self.open[room].pop()
            deep = min(room // length, count)
            wide = min(held, count // deep)
            for k in range(deep):
                self.put(length, first, wide, room - k * length)
            count -= deep * wide
            if room - deep * length:
                self.open[room - deep * length].append((first, wide))
            if held > wide:
                self.open[room].append((first + wide, held - wide))


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[tuple]:
    """(length, first rank, count, first sequence, offset) for all pieces of a length histogram."""
    made = Plan(capacity)
    made.configure(grouped({length: n for length, n in counts.items() if length > small}, groups))
    for length in sorted((x for x in counts if x <= small), reverse=True):
        made.best_fit(length, counts[length])
    return made.placed


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece with ``sequence_id`` and ``offset``: sequences of at most ``capacity`` tokens, without gaps.

    Only documents longer than the capacity are cut; their first piece may be
    shorter, so every other piece fills a sequence. A null or empty text is the
    end token alone. Rows that repeat an id, or have none, are packed each for
    itself. An empty table gives none.
    """
    held = settled(tokenised(docs, path, capacity, id_column, text_column), "pieces")
    by_part = held.groupBy("p", "length").count()
    counts = {r[0]: r[1] for r in held.groupBy("length").count().collect()}  # at most ``capacity`` rows
    placed = plan(counts, capacity, groups, capacity // 4 if small is None else small)
    by_length: dict[int, list] = defaultdict(list)
    for length, rank, _, sequence, offset in placed:
        by_length[length].append((rank, sequence, offset))
    runs = docs.sparkSession.createDataFrame(
        [(length, sorted(of)) for length, of in by_length.items()],
        "length bigint, runs array<struct<rank:bigint,sequence:bigint,offset:bigint>>")
    earlier = Window.partitionBy("length").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("p", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("nth")
    run = F.element_at(F.filter("runs", lambda r: r["rank"] <= rank), -1)
    return (
        held.join(broadcast_if_small(settled(bases, "bases")), ["p", "length"])
        .join(F.broadcast(runs), "length")
        .select("doc_id", "piece", "start", "length", "ids_crc32",
                (run["sequence"] + rank - run["rank"]).alias("sequence_id"), run["offset"].alias("offset"))
    )


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
