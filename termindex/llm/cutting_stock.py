"""Packing by cutting-stock column generation, without padding.

Documents are tokenised once; whole stretches of ``capacity`` tokens are split off
long ones, and the lengths of all pieces are counted. The rest of the plan needs
the counts only. Lengths are rounded up to at most ``CLASSES`` sizes. A linear
program over patterns (how many pieces of each size one sequence takes) is solved by
column generation: a knapsack dynamic program prices the next pattern with the duals
of the present basis, until none can lower the number of sequences by more than
``TOLERANCE``. Patterns are used a whole number of times; actual lengths take the
places of the rounded ones, the longest of a size first; what is left over goes
where it fits best. The emptiest sequences are then taken apart, and their documents
are cut to fill the gaps of all others, one stream into the next. What the gaps do
not take is laid out in sequences of powers of two, which need no padding either.

A plan is a list of runs: equal sequences that hold consecutive ranks of the same
lengths. Its size depends on the number of different lengths, not on the rows. A
piece finds its run by its rank among the pieces of its length (those in earlier
partitions, and those before it in its own); a piece of the stream finds its gaps by
its place in the stream.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termindex.llm.common import broadcast_if_small, read, texts
from termindex.session import settled

CAPACITY = 4096
END = 2
CLASSES = 96
TOLERANCE = 5e-4
SAND = 64  # lengths below a 64th of the capacity are left out of the program and close gaps instead
BLOCK_BYTES = 12 << 20
BATCH_BYTES = 4 << 20


class Words:
    """Ids of texts, by the words between ASCII blanks.

    The tokenizers file lower-cases, drops blanks and never joins characters across one, so the ids of a text
    are those of its words. A block of texts is cut into words by Arrow, and each different word of the block is
    encoded once: Latin ones all together by ``tiktoken`` with the ranks of the same file, whose marks of word ends
    become a byte of their own behind each part; all others by ``tokenizers`` itself.
    """

    # How the file cuts a word, and the characters whose form and case are the same in all libraries.
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}\x02]+"
    LATIN = "^[\x21-\x7e\xa1-\u012f\u0131-\u017f]*$"

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte_of[c] for c in word.removesuffix("</w>")) + b"\x01" * word.endswith("</w>"): n
                 for word, n in vocabulary.items()}
        self.between = ranks[b"\x02"]
        self.many = tiktoken.Encoding("parts", pat_str="[^\x01\x02]+\x01|\x02", mergeable_ranks=ranks, special_tokens={})
        self.parts = regex.compile(self.PARTS)

    def _encoded(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        latin = pc.and_not(pc.match_substring_regex(words, self.LATIN), pc.match_substring(words, "<|"))
        # Words of other kinds leave an empty place, which is filled afterwards.
        common = pc.if_else(latin, words, "").to_pylist()
        marked = self.parts.sub("\\g<0>\x01", "\x02".join(common).lower())
        ids = np.array(self.many.encode_ordinary(marked), dtype="<u4")
        ends = np.concatenate([np.flatnonzero(ids == self.between), [len(ids)]])
        sizes = np.diff(ends, prepend=-1) - 1
        table = np.delete(ids, ends[:-1])
        others = np.flatnonzero(~np.asarray(latin))
        if not len(others):
            return table, sizes
        found = [self.library.encode(word, add_special_tokens=False).ids for word in words.take(pa.array(others)).to_pylist()]
        places = np.repeat((np.cumsum(sizes) - sizes)[others], [len(f) for f in found])
        sizes[others] = [len(f) for f in found]
        return np.insert(table, places, np.array([n for f in found for n in f], dtype="<u4")), sizes

    def ids(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian 32-bit numbers."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        if not len(words):
            yield from (np.array([], dtype="<u4") for _ in range(len(texts)))
            return
        codes = words.indices.to_numpy()
        table, sizes = self._encoded(words.dictionary)
        counts = sizes[codes]
        ends = np.cumsum(counts)
        flat = table[np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - counts), counts) + np.arange(ends[-1])]
        borders = np.concatenate([[0], ends])[np.asarray(split.offsets) - split.offsets[0].as_py()]
        for row in range(len(texts)):
            yield flat[borders[row]:borders[row + 1]]


def in_blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose texts have about ``BLOCK_BYTES`` together."""
    size = np.asarray(pc.binary_length(batch.column(1))).cumsum() // BLOCK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(cuts, cuts[1:], strict=False):
        if end > begin:
            yield batch.slice(begin, end - begin)


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, id_column: str = "doc_id",
              text_column: str = "text") -> DataFrame:
    """(p, doc_id, start, length, doc_tokens, nth, ids_crc32, ids): documents and their whole stretches.

    ``nth`` counts the pieces of one length in partition ``p``; ``ids`` are little-endian 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, p = Words(path), Counter(), TaskContext.get().partitionId()
        end = np.array([END], dtype="<u4").tobytes()
        names = ["p", "doc_id", "start", "length", "doc_tokens", "nth", "ids_crc32", "ids"]
        kinds = [pa.int32()] + [pa.int64()] * 6 + [pa.binary()]

        def packed(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows, held = [], 0
        for batch in batches:
            for block in in_blocks(batch):
                for key, ids in zip(block.column(0).to_pylist(), words.ids(block.column(1)), strict=True):
                    total = len(ids) + 1
                    data = ids.tobytes() + end
                    for start in range(0, total, capacity):
                        piece = data[4 * start:4 * (start + capacity)]
                        length = len(piece) // 4
                        rows.append((p, key, start, length, total, seen[length], zlib.crc32(piece), piece))
                        seen[length] += 1
                        held += len(piece)
                        if held >= BATCH_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
        if rows:
            yield packed(rows)

    return texts(docs, id_column, text_column).mapInArrow(
        run, "p int, doc_id bigint, start bigint, length bigint, doc_tokens bigint, nth bigint, ids_crc32 bigint, ids binary")


def classes(counts: dict[int, int], most: int) -> list[tuple[int, list[list[int]]]]:
    """(size, [[length, count], ...]) in descending order: at most ``most`` sizes, rounding up wastes about as much in each."""
    lengths = sorted(counts, reverse=True)

    def cut(budget: int) -> list[tuple[int, list[list[int]]]]:
        out, spent = [], 0
        for length in lengths:
            waste = (out[-1][0] - length) * counts[length] if out else 0
            if not out or spent + waste > budget:
                out.append((length, []))
                spent = waste = 0
            spent += waste
            out[-1][1].append([length, counts[length]])
        return out

    if not lengths:
        return []
    enough = bisect.bisect_left(range(lengths[0] * sum(counts.values()) + 1), True, key=lambda b: len(cut(b)) <= most)
    return cut(enough)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest total worth that fits: a knapsack by dynamic programming over all capacities.

    A size comes in bundles of 1, 2, 4, ... copies, so each number of copies is a choice of bundles.
    """
    best, steps = np.zeros(capacity + 1), []
    for j in np.flatnonzero(worth > 1e-12):
        left, bundle = capacity // int(sizes[j]), 1
        while left:
            copies = min(bundle, left)
            weight = copies * int(sizes[j])
            with_it = best[:-weight] + copies * worth[j]
            better = with_it > best[weight:] + 1e-12
            steps.append((j, copies, weight, better))
            best = best.copy()
            best[weight:][better] = with_it[better]
            left -= copies
            bundle *= 2
    pattern, room = np.zeros(len(sizes)), int(best.argmax())
    value = float(best[room])
    for j, copies, weight, better in reversed(steps):
        if room >= weight and better[room - weight]:
            pattern[j] += copies
            room -= weight
    return value, pattern


def generate(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = TOLERANCE,
             start: np.ndarray | None = None, turns: int | None = None) -> list[tuple[float, np.ndarray]]:
    """(times, pattern) that cover ``demand`` with, up to ``tolerance``, the least number of sequences.

    ``start`` is a basis whose patterns can cover the demand, ``turns`` the most patterns that may enter.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float)) if start is None else start.copy()
    inverse = np.linalg.inv(basis)
    times = np.maximum(inverse @ demand, 0)
    for turn in range(50 * m if turns is None else turns):
        duals = inverse.sum(axis=0)
        value, pattern = best_pattern(sizes, duals, capacity)
        # total / value is a lower bound of the optimum, and whole numbers of sequences are wanted.
        if value <= 1 + max(tolerance, 0.5 / times.sum()):
            break
        change = inverse @ pattern
        able = np.flatnonzero(change > 1e-9)
        leaving = able[(times[able] / change[able]).argmin()]
        basis[:, leaving] = pattern
        if turn % 64 == 63:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[leaving] / change[leaving]
            inverse = inverse - np.outer(change, row)
            inverse[leaving] = row
        times = np.maximum(inverse @ demand, 0)
    return [(float(x), basis[:, k].astype(int)) for k, x in enumerate(times)]


@dataclass
class Run:
    """``count`` sequences that hold the same lengths; the k-th one holds rank first + k of each."""

    count: int
    items: list[tuple[int, int]]  # (length, first rank)

    def fill(self) -> int:
        return sum(length for length, _ in self.items)

    def split(self, count: int) -> Run:
        """Take the first ``count`` sequences off."""
        head = Run(count, list(self.items))
        self.count -= count
        self.items = [(length, first + count) for length, first in self.items]
        return head


class Plan:
    """All sequences as runs, and the stream of pieces that are cut to fill their gaps."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, most: int = CLASSES, tolerance: float = TOLERANCE,
                 least: int = 1):
        self.capacity, self.least = capacity, least
        self.rank: Counter = Counter()
        self.runs: list[Run] = []
        sand = capacity // SAND
        self._by_patterns({length: n for length, n in counts.items() if length > sand}, most, tolerance)
        self._best_fit({length: n for length, n in counts.items() if length <= sand})
        self._pour()

    def _take(self, length: int, count: int) -> int:
        first = self.rank[length]
        self.rank[length] += count
        return first

    def _by_patterns(self, counts: dict[int, int], most: int, tolerance: float) -> None:
        sizes = classes(counts, most)
        if not sizes:
            return
        size = np.array([s for s, _ in sizes], dtype=np.int64)
        left = np.array([sum(n for _, n in of) for _, of in sizes], dtype=np.int64)
        queues = [of for _, of in sizes]
        found = generate(size, left.astype(float), self.capacity, tolerance)
        for times, pattern in found:
            whole = int(min([int(times + 1e-6)] + [int(left[j] // pattern[j]) for j in np.flatnonzero(pattern)]))
            left -= whole * pattern
            self._substitute(pattern, whole, queues)
        for times, pattern in sorted(found, key=lambda f: -(f[0] % 1)):  # the fractions: once more where it is full
            if times % 1 > 1e-6 and (pattern <= left).all():
                left -= pattern
                self._substitute(pattern, 1, queues)
        self._best_fit({length: n for of in queues for length, n in of if n})

    def _substitute(self, pattern: np.ndarray, times: int, queues: list[list[list[int]]]) -> None:
        slots = []  # for each place in the pattern: the actual lengths and how many times each
        for j in np.flatnonzero(pattern):
            for _ in range(int(pattern[j])):
                need, parts = times, []
                while need:
                    length, count = queues[j][0]
                    use = min(need, count)
                    parts.append([length, use])
                    need -= use
                    if use == count:
                        queues[j].pop(0)
                    else:
                        queues[j][0][1] -= use
                slots.append(parts)
        done = 0
        while done < times:
            same = min(parts[0][1] for parts in slots)
            self.runs.append(Run(same, [(parts[0][0], self._take(parts[0][0], same)) for parts in slots]))
            for parts in slots:
                parts[0][1] -= same
                if not parts[0][1]:
                    parts.pop(0)
            done += same

    def _best_fit(self, counts: dict[int, int]) -> None:
        """The longest first; each goes to a sequence with the least room that holds it."""
        by_room: dict[int, list[Run]] = defaultdict(list)
        for run in self.runs:
            by_room[self.capacity - run.fill()].append(run)
        rooms = sorted(by_room)
        for length in sorted(counts, reverse=True):
            count = counts[length]
            while count:
                at = bisect.bisect_left(rooms, length)
                while at < len(rooms) and not by_room[rooms[at]]:
                    rooms.pop(at)
                if at < len(rooms):
                    room = rooms[at]
                    run = by_room[room].pop()
                else:
                    room = self.capacity
                    run = Run(-(-count // (room // length)), [])
                    self.runs.append(run)
                deep = min(room // length, count)
                wide = min(run.count, count // deep)
                if wide < run.count:
                    head = run.split(wide)
                    self.runs.append(head)
                    by_room[room].append(run)
                    if room not in rooms:
                        bisect.insort(rooms, room)
                    run = head
                run.items += [(length, self._take(length, wide)) for _ in range(deep)]
                count -= deep * wide
                room -= deep * length
                by_room[room].append(run)
                if room and (p := bisect.bisect_left(rooms, room)) == len(rooms) or room and rooms[p] != room:
                    rooms.insert(p, room)

    def _pour(self) -> None:
        """Take the emptiest sequences apart until what they hold fills the gaps of the others."""
        runs = sorted((r for r in self.runs if r.count and r.items), key=Run.fill)
        gaps = [self.capacity - r.fill() for r in runs]
        wanted = -(-sum(g * r.count for g, r in zip(gaps, runs, strict=True) if g >= self.least) // self.capacity)
        donors, kept = [], []
        for run, gap in zip(runs, gaps, strict=True):
            if wanted and gap >= self.least:
                taken = run if run.count <= wanted else run.split(wanted)
                wanted -= taken.count
                donors.append(taken)
                if taken is run:
                    continue
            kept.append(run)
        self.whole = []   # (length, first rank, count, first sequence, offset)
        self.stream = []  # (length, first rank, count, place of the first in the stream)
        self.gaps = []    # (place in the stream, count, width, first sequence, offset)
        poured = sequence = 0
        for length, first, count in sorted(((length, first, run.count) for run in donors for length, first in run.items), reverse=True):
            self.stream.append((length, first, count, poured))
            poured += length * count
        at = 0
        for run in kept:
            offset = 0
            for length, first in run.items:
                self.whole.append((length, first, run.count, sequence, offset))
                offset += length
            width = self.capacity - offset
            if width >= self.least and at < poured:
                full = min(run.count, (poured - at) // width)
                self.gaps.append((at, full, width, sequence, offset))
                at += full * width
                if full < run.count and at < poured:  # only with ``least`` above 1 or an uneven end
                    self.gaps.append((at, 1, poured - at, sequence + full, offset))
                    at = poured
            sequence += run.count
        rest = poured - at
        while rest:
            width = min(1 << (rest.bit_length() - 1), self.capacity)
            self.gaps.append((at, 1, width, sequence, 0))
            sequence, at, rest = sequence + 1, at + width, rest - width
        self.sequences = sequence


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, most: int = CLASSES, tolerance: float = TOLERANCE,
         least: int = 1, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with ``ids`` if wanted.

    Sequences have at most ``capacity`` tokens and no gaps. With ``least`` 1 each is full or has a length of a power of
    two; a larger ``least`` leaves gaps below it, so that no document is cut for them. A null or empty text is the end
    token alone. Rows that repeat an id, or have none, are packed each for itself. An empty table gives none.
    """
    held = settled(tokenised(docs, path, capacity, id_column, text_column), "pieces")
    counts = {r[0]: r[1] for r in held.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = Plan(counts, capacity, most, tolerance, least)
    by_length: dict[int, list] = defaultdict(list)
    for length, first, _, sequence, offset in plan.whole:
        by_length[length].append((first, sequence, offset, None))
    for length, first, _, place in plan.stream:
        by_length[length].append((first, None, None, place))
    runs = docs.sparkSession.createDataFrame(
        [(length, sorted(of, key=lambda r: r[0])) for length, of in by_length.items()],
        "length bigint, runs array<struct<first:bigint,sequence:bigint,offset:bigint,place:bigint>>")
    earlier = Window.partitionBy("length").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.groupBy("p", "length").count().select(
        "p", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    bases = broadcast_if_small(settled(bases, "bases"))
    rank = F.col("base") + F.col("nth")

    def placed(columns: list[str]) -> DataFrame:
        found = held.select("p", "nth", *columns).join(bases, ["p", "length"]).join(F.broadcast(runs), "length")
        return found.withColumn("run", F.element_at(F.filter("runs", lambda r: r["first"] <= rank), -1)).withColumn(
            "after", rank - F.col("run.first"))

    last = ["ids"] if with_ids else []
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = placed([*names, *last]).filter("run.sequence IS NOT NULL").select(
        *names, (F.col("run.sequence") + F.col("after")).alias("sequence_id"), F.col("run.offset").alias("offset"), *last)
    streamed = placed(["doc_id", "start", "length", "doc_tokens", "ids"]).filter("run.place IS NOT NULL").select(
        "doc_id", "start", "doc_tokens", (F.col("run.place") + F.col("after") * F.col("length")).alias("place"), "ids")
    return whole.unionByName(cut_up(streamed, plan.gaps, with_ids))


def cut_up(streamed: DataFrame, gaps: list[tuple[int, int, int, int, int]], with_ids: bool = False) -> DataFrame:
    """The pieces of the stream, cut where one gap ends and the next begins."""
    table = np.array(gaps, dtype=np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][:7 + with_ids]
        kinds = [pa.int64()] * 7 + [pa.binary()]
        for batch in batches:
            rows = []
            for key, start, total, place, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                done, length = 0, len(ids) // 4
                while done < length:
                    begin, _, width, sequence, offset = map(int, table[np.searchsorted(table[:, 0], place + done, side="right") - 1])
                    nth, inside = divmod(place + done - begin, width)
                    size = min(length - done, width - inside)
                    piece = ids[4 * done:4 * (done + size)]
                    rows.append((key, start + done, size, zlib.crc32(piece), total, sequence + nth, offset + inside, piece)[:7 + with_ids])
                    done += size
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    schema = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
              "offset bigint" + (", ids binary" if with_ids else ""))
    return streamed.mapInArrow(run, schema)


def op11_cutting_stock(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
