"""N-gram Jaccard join by PartEnum signatures.

Documents become sets of hashed shingles; equal sets are one class. Sizes are
cut into bands so that two similar sets are in one band or in neighbours, and a
class signs for its own band and the one below. For a band, ``k`` bounds the
symmetric difference of two similar sets. The feature domain is cut into
``n1 > k`` parts, and a signature is the projection of the set on one part: as a
set that fills more than ``k`` parts agrees with each similar set in at least
one of them, the two share a signature. Where a set fills too few, it signs
again with more, smaller parts (the next level), until it fills enough; of two
sets at least one passes at the lower of their levels.

On the first level shingles that a sample found frequent are left out. They may
be any set of shingles without losing a pair, since leaving out shingles never
makes a difference larger, and passages that many documents share then make no
signatures.

Signatures that classes share give stars: one member of each signature group is
tied to the others, first inside a batch, then between batches, so a group is
never larger than the number of batches in any task. The member that shares most
signatures, the likely origin of a family of copies, becomes the hub of its
groups, which are its family. Pairs of hub and member pass an exact filter first (bitmaps that hold the
parity of the elements per place differ in no more places than the sets in
elements), are then verified on the exact sets, and joined to components. Where
a family still has several components, the filter runs over all pairs between
them, in blocks of bounded size, and tells the members that pass with another one.
Their sets meet in blocks again and are verified there; only links that join two
components are written. So no link between components is lost, and what is
written grows with the members of a family, not with its pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex.llm.common import LAST_ID, broadcast_if_small, order_id, read, texts
from termindex.llm.components import components
from termindex.session import settled

WORDS = 5
SAMPLE_TEXTS = 4000
FREQUENT, MAX_FREQUENT = 3, 100_000  # occurrences in the sample that make a shingle frequent; how many are kept
FLUSH = 500_000  # signatures held in a task
MEET = 250_000  # signatures sorted at once where they meet
KNOWN = 1 << 20
ROWS = 256  # texts shingled at once
BLOCK = 2048  # members of a group compared with as many others at once
SET_BYTES = 32 << 20  # of their sets, where these are compared
TOGETHER = 64  # sets compared with one at once
SPARE = 1.25  # parts per needed part
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD,
                   0x2545F4914F6CDD1D], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def similar(shared: int, a: int, b: int) -> bool:
    """Jaccard 0.75 or more."""
    return 100 * shared >= 75 * (a + b - shared)


def bands(longest: int) -> tuple[list[int], list[int]]:
    """Lower bounds of the bands from size 3 on, and the largest difference of two similar sets that meet in a band."""
    low = [3]
    while low[-1] <= longest or len(low) < 3:
        low.append(max(low[-1] + 1, 4 * (low[-1] - 1) // 3 + 1))
    low.append(max(low[-1] + 1, 4 * (low[-1] - 1) // 3 + 1))
    k = []
    for i in range(len(low) - 2):
        a = low[i + 1] - 1
        k.append((a + min(low[i + 2] - 1, 4 * a // 3)) // 7)
    return low[:len(k)], k


class Bands:
    def __init__(self):
        self.low, self.k = bands(1 << 12)

    def of(self, size: int) -> list[tuple[int, int]]:
        """(band, k) that a set of this size signs for."""
        if size > self.low[-1]:
            self.low, self.k = bands(2 * size)
        i = int(np.searchsorted(self.low, size, side="right")) - 1
        return [(t, self.k[t]) for t in (i, i - 1) if t >= 0 and self.k[t] > 0]


def signatures(shingles: np.ndarray, frequent: np.ndarray, held: Bands) -> np.ndarray:
    """The signatures of a set of at least three shingles, in 64 bits each."""
    out = []
    place, value = mix(shingles + _M3), mix(shingles ^ _M2)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rare = frequent[at] != shingles
    else:
        rare = np.ones(len(shingles), dtype=bool)
    for band, k in held.of(len(shingles)):
        level = 0
        while True:
            parts = int(SPARE * (k + 1)) + 1 if level < 2 else (k + 1) << (level - 1)
            p, v = (place[rare], value[rare]) if level == 0 else (place, value)
            p = (p % np.uint64(parts)).astype(np.int64)
            sums = np.zeros(parts, dtype=np.uint64)
            np.add.at(sums, p, v)
            full = np.flatnonzero(np.bincount(p, minlength=parts))
            tag = np.uint64((band << 40) + (level << 32))
            out.append(mix(sums[full] + mix(full.astype(np.uint64) + tag)))
            if len(full) > k:
                break
            level += 1
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def rows_of(docs: DataFrame) -> DataFrame:
    """(id, text, text_hash) of each row."""
    return docs.select(order_id().alias("id"), "text", F.xxhash64("text").alias("text_hash"))


_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _M3)[_LOWER]  # a number for each byte, A-Z as a-z
_STEP = 1 << 16


class WordHashes:
    """Hashes of the words of many texts at once: a polynomial in 64 bits of the numbers of their bytes."""

    def __init__(self):
        self.near, self.far = (self._powers(pow(int(_M1), e, 1 << 64)) for e in (1, _STEP))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.ones(1, dtype=np.uint64)
        while len(out) < _STEP:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        return out

    def of(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, where each text's words begin) of the bytes of texts that begin at ``starts`` (with the end last)."""
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = starts[:-1][starts[:-1] < len(data)]
        first[heads] = inside[heads]
        begins = np.flatnonzero(first)
        bounds = np.searchsorted(begins, starts)
        if not len(begins):
            return np.zeros(0, dtype=np.uint64), bounds
        at = np.flatnonzero(inside)
        word = np.cumsum(first)[at] - 1
        place = at - begins[word]
        value = _BYTE[data[at]] * self.near[place % _STEP]
        if place.max() >= _STEP:
            value *= self.far[place // _STEP]
        cuts = np.searchsorted(at, begins)
        length = np.diff(np.append(cuts, len(at))).astype(np.uint64)
        return mix(np.add.reduceat(value, cuts) + length * _M2), bounds


_HASHES = WordHashes()


def shingle_sets(texts: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words is one shingle."""
    texts = texts.cast(pa.large_string())
    _, offsets, held = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    for begin in range(0, len(texts), ROWS):
        part = offsets[begin:begin + ROWS + 1]
        yield from _shingled(*_HASHES.of(whole[part[0]:part[-1]], part - part[0]), n)


def _shingled(words: np.ndarray, ends: np.ndarray, n: int) -> Iterator[np.ndarray]:
    count = max(0, len(words) - n + 1)
    joined = np.zeros(count, dtype=np.uint64)
    for t in range(n):
        joined += words[t:t + count] * _PLACE[t]
    joined = mix(joined)
    for begin, end in zip(ends[:-1], ends[1:], strict=True):
        size = int(end - begin)
        if size >= n:
            yield np.unique(joined[begin:end - n + 1])
        elif size:
            yield mix((words[begin:end] * _PLACE[:size]).sum(keepdims=True) + np.uint64(size) * _PLACE[5])
        else:
            yield np.zeros(0, dtype=np.uint64)


def parities(shingles: np.ndarray) -> bytes:
    """The parity of the elements per place, for as many places as the next power of two from the size on."""
    places = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    at = (mix(shingles ^ _M3) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A bitmap for fewer places (64 to a word)."""
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def may_be_similar(x: bytes, y: bytes, a: int, b: int) -> bool:
    """False only if the sets of sizes a and b are not similar."""
    if 100 * min(a, b) < 75 * max(a, b):
        return False
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) * 7 <= a + b


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit hash of the set, as a signed number."""
    return int((mix(shingles ^ _M1).sum(keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])


def _columns(batch: pa.RecordBatch) -> tuple[pa.Array, Iterator[np.ndarray]]:
    return batch.column(0), shingle_sets(batch.column(1))


def class_members(docs: DataFrame) -> DataFrame:
    """(id, n, class, bitmap, text_hash) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = _columns(batch)
            told = [(len(s), class_of(s), parities(s)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([n for n, _, _ in told], pa.int64()), pa.array([c for _, c, _ in told], pa.int64()),
                 pa.array([b for _, _, b in told], pa.binary()), batch.column(2)],
                names=["id", "n", "class", "bitmap", "text_hash"])

    return rows_of(docs).mapInArrow(run, "id bigint, n bigint, class bigint, bitmap binary, text_hash bigint")


def class_sets(docs: DataFrame) -> DataFrame:
    """(class, set): the shingles as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_columns(batch)[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["class", "set"])

    return rows_of(docs).mapInArrow(run, "class bigint, set binary")


def frequent_shingles(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> np.ndarray:
    """Shingles found in several different texts of a bounded sample; a choice of speed, not of results."""
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_texts)
    sets = class_sets(docs.join(F.broadcast(chosen), "doc_id")).dropDuplicates(["class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(one.as_buffer(), dtype=np.int64), pa.int64())], names=["shingle"])

    counts = sets.select("set").mapInArrow(run, "shingle bigint").groupBy("shingle").count()
    most = counts.filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "shingle").limit(MAX_FREQUENT)
    return np.sort(np.array([r[0] for r in most.collect()], dtype=np.int64).view(np.uint64))


def even_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each partition a number that hash partitioning sends there, so that as many buckets fill all partitions."""
    found = spark.range(40 * parts + 400).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("part")).agg(F.min("id").alias("key"))
    return [r["key"] for r in found.orderBy("part").collect()]


def _stars(sigs: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by (signature, class) and drop repetitions; (order, place of the first of its signature)."""
    order = np.lexsort((classes, sigs))
    s, c = sigs[order], classes[order]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
    order = order[keep]
    s = s[keep]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    return order, np.flatnonzero(new)[np.cumsum(new) - 1] if len(s) else np.zeros(0, np.int64)


LOW48 = np.uint64((1 << 48) - 1)


def star_links(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(sig, a, b): in each group of classes with one signature, ``a`` stands for the group and ``b`` is another member.

    Groups met inside a batch are linked there, and only their first member
    travels on. What travels is packed: per batch and bucket the low 48 bits of
    the signatures and their classes by number.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys, meet = np.array(even_keys(spark, parts), dtype=np.int64), MEET

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sigs, classes, size, turn = Bands(), [], [], 0, 0
        known = np.zeros(KNOWN, dtype=np.int64)  # classes met before; a place keeps the last one
        for batch in batches:
            for shingles in _columns(batch)[1]:
                if len(shingles) < 3:
                    continue  # only an equal set could be similar
                c = class_of(shingles)
                if known[c % KNOWN] == c:
                    continue
                known[c % KNOWN] = c
                sigs.append(signatures(shingles, frequent, held))
                classes.append(np.full(len(sigs[-1]), c, dtype=np.int64))
                size += len(sigs[-1])
                if size >= FLUSH:
                    yield packed(sigs, classes, turn)
                    sigs, classes, size, turn = [], [], 0, turn + 1
        if size:
            yield packed(sigs, classes, turn)

    def packed(sigs: list, classes: list, turn: int) -> pa.RecordBatch:
        sig, cls = np.concatenate(sigs), np.concatenate(classes)
        order, first = _stars(sig, cls)
        sig, cls = sig[order], cls[order]
        bucket = ((sig >> np.uint64(48)) % np.uint64(len(keys))).astype(np.int64)
        low = sig & LOW48
        leads = first == np.arange(len(first))
        rows: list[tuple[int, int, bytes]] = []
        by = np.argsort(bucket[leads], kind="stable")
        b, s, c = bucket[leads][by], low[leads][by], cls[leads][by]
        cuts = np.searchsorted(b, np.arange(len(keys) + 1))
        for k in range(len(keys)):
            at = slice(cuts[k], cuts[k + 1])
            if cuts[k + 1] > cuts[k]:
                table, number = np.unique(c[at], return_inverse=True)
                small = np.uint16 if len(table) < 1 << 16 else np.uint32
                rows.append((int(keys[k]), k, b"".join([
                    np.array([cuts[k + 1] - cuts[k], len(table), small().itemsize], np.int64).tobytes(),
                    table.tobytes(), (s[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                    (s[at] >> np.uint64(32)).astype(np.uint16).tobytes(), number.astype(small).tobytes()])))
        rest = np.flatnonzero(~leads)
        for n, begin in enumerate(range(0, len(rest), 1 << 18)):  # links inside the batch, to any bucket
            at = rest[begin:begin + (1 << 18)]
            told = np.stack([_group(low[at], bucket[at]), cls[first[at]], cls[at]])
            rows.append((int(keys[(n + turn + int(cls[at[0]])) % len(keys)]), -1, zlib.compress(told.tobytes(), 1)))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["key", "bucket", "blob"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0  # packed as they came
        for batch in batches:
            for bucket, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = blob.as_py()
                if bucket < 0:
                    yield told(*np.frombuffer(zlib.decompress(data), dtype=np.int64).reshape(3, -1))
                else:
                    parts.append((bucket, data))
                    total += int(np.frombuffer(data, np.int64, 1)[0])
        turns = -(-total // meet)
        for turn in range(turns):  # the signatures of one remainder at a time
            sigs, classes = [], []
            for bucket, data in parts:
                n, t, width = np.frombuffer(data, np.int64, 3)
                table = np.frombuffer(data, np.int64, t, 24)
                at = 24 + 8 * t
                low, high = np.frombuffer(data, np.uint32, n, at), np.frombuffer(data, np.uint16, n, at + 4 * n)
                number = np.frombuffer(data, np.uint16 if width == 2 else np.uint32, n, at + 6 * n)
                now = np.flatnonzero(low % np.uint32(turns) == turn)
                sig = low[now].astype(np.uint64) | high[now].astype(np.uint64) << np.uint64(32)
                sigs.append(_group(sig, np.full(len(now), bucket, np.int64)))
                classes.append(table[number[now]])
            sig, cls = np.concatenate(sigs), np.concatenate(classes)
            order, first = _stars(sig, cls)
            rest = np.flatnonzero(first != np.arange(len(first)))
            yield told(sig[order[rest]], cls[order[first[rest]]], cls[order[rest]])

    def told(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(a), pa.array(b)], names=["sig", "a", "b"])

    return (
        rows_of(docs).mapInArrow(signed, "key bigint, bucket int, blob binary")
        .repartition(parts, "key").mapInArrow(met, "sig bigint, a bigint, b bigint")
    )


def _group(low: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The number of a signature group, from the 48 bits and the bucket."""
    return mix(low + (bucket.astype(np.uint64) << np.uint64(48)) * _M3).view(np.int64)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("class").alias("a"), F.col("set").alias("set_a"))
    other = sets.select(F.col("class").alias("b"), F.col("set").alias("set_b"))
    return pairs.select("a", "b").join(other, "b").join(one, "a").select("a", "b", "set_a", "set_b").mapInArrow(
        run, "a bigint, b bigint")


def filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sizes and bitmaps of their classes do not exclude."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_be_similar(*row) for row in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, other = (classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"bitmap_{x}"))
                  for x in "ab")
    return pairs.join(one, "a").join(other, "b").select("a", "b", "bitmap_a", "bitmap_b", "n_a", "n_b").mapInArrow(
        run, "a bigint, b bigint")


def in_blocks(groups: DataFrame, blocks: Column) -> DataFrame:
    """The members of families (hub, node, ...) dealt out to pairs of blocks (hub, i, j, ...), the rows of a pair together.

    ``blocks`` tells from the rows of a family into how many blocks it is cut. Each member meets each other in some pair.
    """
    sizes = groups.groupBy("hub").agg(blocks.cast("int").alias("blocks"))
    own = F.pmod(F.hash("node"), F.col("blocks"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    return groups.join(sizes, "hub").withColumn("at", F.explode(others)).select(
        "hub", "at.i", "at.j", *[c for c in groups.columns if c != "hub"])


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """(hub, its rows) of each pair of blocks."""
    held, where = [], None
    for batch in batches:
        for hub, i, j, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (hub, i, j) != where:
                if held:
                    yield where[0], held
                held, where = [], (hub, i, j)
            held.append(row)
    if held:
        yield where[0], held


def _told(found: list[tuple[int, int]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=names)


def across(groups: DataFrame) -> DataFrame:
    """Of families (hub, node, comp, n, bitmap): the members (hub, node) that the filter does not exclude from being
    similar to one of another component.

    A family is dealt out to blocks of about ``BLOCK`` members, and each pair of blocks is compared for itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for hub, members in _families(batches):
            found += [(hub, node) for node in _met_across(members)]
            if len(found) > 100_000:
                yield _told(found, ["hub", "node"])
                found = []
        if found:
            yield _told(found, ["hub", "node"])

    dealt = in_blocks(groups, F.ceil(F.count("*") / BLOCK)).select("hub", "i", "j", "comp", "node", "n", "bitmap")
    return dealt.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(
        run, "hub bigint, node bigint").distinct()


def forest(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Of families (hub, node, comp, n, bitmap): similar pairs (a, b) that join all components that similar pairs join.

    The sets are compared where the blocks meet, so what is written for a pair of blocks is fewer rows than it has
    components, however many pairs are similar. Blocks are bounded in members and in the bytes of their sets.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _families(batches):
            if found := list(_links_across(members)):
                yield _told(found, ["a", "b"])

    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(8 * F.col("n")) / SET_BYTES))
    dealt = in_blocks(groups, blocks).join(sets.select(F.col("class").alias("node"), "set"), "node").select(
        "hub", "i", "j", "comp", "node", "n", "bitmap", "set")
    return dealt.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(
        run, "a bigint, b bigint").distinct()


def _near_across(comp: np.ndarray, size: np.ndarray, bitmaps: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(first member, which of it and the next ones go with which members): what the filter lets pass across components.

    Each pair is met once. Members outside the largest component come first: every pair across components has one.
    """
    maps = [np.frombuffer(m, np.uint64) for m in bitmaps]
    words = min(map(len, maps))
    maps = np.stack([folded(m, words) for m in maps])
    outside = len(comp) - int(np.unique(comp, return_counts=True)[1].max())
    step = max(1, (1 << 18) // maps.size)  # about 2 MB at once
    for begin in range(0, outside, step):
        i = slice(begin, min(begin + step, outside))
        low, high = np.minimum(size[i, None], size), np.maximum(size[i, None], size)
        fits = (comp[i, None] != comp) & (100 * low >= 75 * high) & (np.arange(len(comp)) > np.arange(len(comp))[i, None])
        apart = np.bitwise_count(maps[i, None, :] ^ maps[None, :, :]).sum(axis=2, dtype=np.int64)
        yield begin, fits & (7 * apart <= low + high)


def _largest_last(members: list[list]) -> list[list]:
    """Members (comp, ...) with those of the largest component last."""
    counts = Counter(m[0] for m in members)
    largest = max(counts, key=counts.__getitem__)
    return sorted(members, key=lambda m: m[0] == largest)


def _met_across(members: list[list]) -> list[int]:
    """The classes of (comp, class, size, bitmap) that the filter lets pass with one of another component."""
    members = _largest_last(members)
    comp, node, size = (np.array(x, dtype=np.int64) for x in list(zip(*members, strict=True))[:3])
    met = np.zeros(len(node), dtype=bool)
    for begin, near in _near_across(comp, size, [m[3] for m in members]):
        met[begin:begin + len(near)] |= near.any(axis=1)
        met |= near.any(axis=0)
    return node[met].tolist()


def _links_across(members: list[list]) -> Iterator[tuple[int, int]]:
    """Similar pairs (smaller, larger class) of (comp, class, size, bitmap, set): a forest over the components."""
    members = _largest_last(members)
    comp, node, size = (np.array(x, dtype=np.int64) for x in list(zip(*members, strict=True))[:3])
    sets = [np.frombuffer(m[4], np.uint64) for m in members]
    root = np.unique(comp, return_inverse=True)[1]  # the component of each member, as joined so far
    for begin, near in _near_across(comp, size, [m[3] for m in members]):
        for x, row in enumerate(near, start=begin):
            others = np.flatnonzero(row & (root != root[x]))
            while len(others):
                now, others = others[:TOGETHER], others[TOGETHER:]
                for y in now[similar_to(sets[x], [sets[y] for y in now])].tolist():
                    if root[y] != root[x]:
                        root[root == root[y]] = root[x]
                        one, other = int(node[x]), int(node[y])
                        yield (min(one, other), max(one, other))
                others = others[root[others] != root[x]]


def similar_to(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the other sets, none empty, are similar to the one."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    shared = np.add.reduceat(one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every,
                             np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * shared >= 75 * (len(one) + sizes - shared)


def linked_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, comp): the components of classes that are linked with another one."""
    stars = settled(star_links(docs, frequent_shingles(docs)), "stars")
    members = settled(stars.select("sig", F.col("a").alias("node")).union(stars.select("sig", "b")).distinct(), "members")
    shared = broadcast_if_small(settled(members.groupBy("node").agg(F.count("*").alias("shared")), "shared"), row_bytes=32)
    hubs = members.join(shared, "node").groupBy("sig").agg(F.max(F.struct("shared", "node")).alias("hub")).select("sig", "hub.node")
    hubs = settled(hubs.withColumnRenamed("node", "hub"), "hubs")
    pairs = members.join(hubs, "sig").filter("node <> hub").select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    pairs = settled(filtered(pairs, classes), "pairs")
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    links = settled(verified(pairs, sets_of(docs, classes, ends)), "links")
    comps = components(links)

    # All members that have met a hub are its family. In families that still have several components, pairs between
    # these are compared: two sets that share a signature are in the family of its hub.
    known = members.join(hubs, "sig").select("hub", "node").distinct().join(
        broadcast_if_small(comps, row_bytes=32), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = known.groupBy("hub").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("hub")
    groups = settled(known.join(mixed, "hub", "left_semi").join(
        classes.select(F.col("class").alias("node"), "n", "bitmap"), "node").select("hub", "node", "comp", "n", "bitmap"), "groups")
    rest = settled(across(groups), "rest")
    if rest.isEmpty():
        return comps
    sets = sets_of(docs, classes, rest.select(F.col("node").alias("class")).distinct())
    more = settled(forest(groups.join(rest, ["hub", "node"], "left_semi"), sets), "more")
    return comps if more.isEmpty() else components(links.union(more))


def sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(class, set) of some classes, each from one document."""
    asked = settled(nodes.join(classes, "class").select(F.col("rep").alias("id")).distinct(), "asked")
    keyed = docs.withColumn("id", order_id()).join(broadcast_if_small(asked, row_bytes=16), "id", "left_semi")
    return settled(class_sets(keyed.select("doc_id", "text")).dropDuplicates(["class"]), "sets")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, group, text_hash): one row per row of ``docs``.

    Two documents are linked when their sets of 5-word shingles have a Jaccard
    similarity of 0.75 or more; ``component_id`` is the smallest id that links
    reach, ``group`` numbers the component (null for a document without shingles).

    A text of fewer than five words is one shingle; a null text or one without
    words has none and is linked with nothing. Rows that repeat an id each have
    the links of their own text. A row without an id counts as the largest id:
    its component is null unless a link reaches a document with one. An empty
    table gives none.
    """
    plain = texts(docs, id_column, text_column)
    members = settled(class_members(plain), "documents")
    classes = settled(members.filter("n > 0").groupBy("class").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.any_value("bitmap").alias("bitmap")), "classes")
    linked = linked_classes(plain, classes)
    known = linked.select(F.col("node").alias("class"), "comp")
    reach = known.join(classes.select("class", "rep"), "class").groupBy("comp").agg(F.min("rep").alias("least"))
    target = classes.join(known.join(reach, "comp"), "class", "left").select(
        "class", F.coalesce("least", "rep").alias("least"), F.coalesce("comp", "class").alias("group"))
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least"))
    named = lambda c: F.when(c != LAST_ID, c)
    return members.join(target, "class", "left").select(
        named(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), named(component).alias("component_id"),
        "group", "text_hash")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with the document of the smallest id of each component.

    Documents without shingles stay. Rows that repeat an id and its text are one document.
    """
    found = settled(near_duplicates(docs, id_column, text_column).filter("n_shingles > 0"), "found")
    ranked = found.withColumn("at", F.struct(order_id().alias("id"), "text_hash"))
    least = ranked.groupBy("group").agg(F.min("at").alias("least"))
    gone = settled(ranked.join(least, "group").filter(F.col("at") != F.col("least")).select("at.*").distinct(), "gone")
    gone = broadcast_if_small(gone.select(F.col("id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")), row_bytes=32)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = F.coalesce(F.col(f"row.`{id_column}`").cast("bigint"), F.lit(LAST_ID))
    text_hash = F.xxhash64(F.coalesce(F.col(f"row.`{text_column}`"), F.lit("")))
    return rows.join(gone, (key == F.col("_gone_id")) & (text_hash == F.col("_gone_hash")), "left_anti").select("row.*")


def op1_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(read(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")
