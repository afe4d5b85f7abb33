"""Document fingerprints from prefix polynomial hashes.

For each text two modular prefix arrays (primes near 2**31) give the hash of any
span in constant time, so spans are compared without reading them and longest
common extensions are found by binary search. A fingerprint holds the length,
the hash of the whole text, and the smallest hashes of its windows.

Each document also meets its successor in descending id order: ids are cut into
buckets of about equal size, each bucket additionally gets the first document of
the bucket after it, and a sorted pass over a bucket sees every neighbour pair.
Texts are shuffled once; a task holds two texts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex.llm.common import order_id, read, texts

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
WINDOW = 8
SKETCH = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of the bases and of their inverses, extended as longer texts come."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def reach(self, n: int) -> None:
        for k, p in enumerate(PRIMES):
            for held, base in ((self.up, BASES[k]), (self.down, pow(BASES[k], -1, p))):
                while len(held[k]) <= n:  # doubling: b**(m+i) = b**m * b**i
                    m = len(held[k])
                    held[k] = np.concatenate([held[k], held[k] * np.uint64(pow(base, m, p)) % np.uint64(p)])


class PrefixHashes:
    """Prefix arrays of a sequence of code points."""

    def __init__(self, points: np.ndarray, powers: Powers, head: PrefixHashes | None = None, keep: int = 0):
        """With ``head``, ``points`` follow its first ``keep`` code points, whose arrays are reused."""
        self.powers, self.n = powers, keep + len(points)
        powers.reach(self.n)
        self.prefix = []
        values = points.astype(np.uint64) + np.uint64(1)  # a leading U+0000 counts
        for k, p in enumerate(PRIMES):
            p = np.uint64(p)
            terms = values * powers.up[k][keep:self.n] % p
            begin = head.prefix[k][:keep + 1] if head else np.zeros(1, np.uint64)
            self.prefix.append(np.concatenate([begin, (begin[-1] + np.cumsum(terms)) % p]))

    def span(self, i, j) -> np.ndarray:
        """The 62-bit hash of code points i to j (exclusive); numbers or arrays of them."""
        out = np.uint64(0)
        for k, p in enumerate(PRIMES):
            p = np.uint64(p)
            part = (self.prefix[k][j] + p - self.prefix[k][i]) % p * self.powers.down[k][i] % p
            out = (out << np.uint64(31)) | part
        return out

    def windows(self, begin: int = 0) -> np.ndarray:
        """Hashes of the spans that end behind each code point from ``begin`` on.

        A span has ``WINDOW`` code points, fewer only where the text begins, so texts of all lengths have as
        many as code points and are compared by one measure.
        """
        ends = np.arange(begin + 1, min(self.n, WINDOW - 1) + 1)
        first = self.span(np.zeros_like(ends), ends) if len(ends) else np.zeros(0, np.uint64)
        begin = max(begin - WINDOW + 1, 0)
        if self.n - WINDOW + 1 <= begin:
            return first
        out = np.zeros(self.n - WINDOW + 1 - begin, np.uint64)
        for k, p in enumerate(PRIMES):
            p = np.uint64(p)
            held = self.prefix[k][begin:]
            part = (held[WINDOW:] + p - held[:-WINDOW]) % p * self.powers.down[k][begin:self.n - WINDOW + 1] % p
            out = (out << np.uint64(31)) | part
        return np.concatenate([first, out])


def spans_equal(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    return bool(a.span(i, i + length) == b.span(j, j + length))


def common_extension(a: PrefixHashes, b: PrefixHashes, i: int = 0, j: int = 0) -> int:
    """The length of the longest common extension from i in ``a`` and j in ``b``."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if spans_equal(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def smallest(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The smallest distinct 32-bit mixes of the window hashes."""
    mixed = hashes * MIX
    mixed = ((mixed ^ (mixed >> np.uint64(29))) * MIX >> np.uint64(32)).astype(np.uint32)
    few = 4 * size
    if len(mixed) > 2 * few:
        low = np.unique(np.partition(mixed, few)[:few])
        if len(low) >= size:
            return low[:size]
    return np.unique(mixed)[:size]


def fingerprint_of(hashes: PrefixHashes, sketch: np.ndarray) -> str:
    whole = int(hashes.span(0, hashes.n)) if hashes.n else 0
    return f"{hashes.n:x}-{whole:016x}-{sketch.astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str, size: int = SKETCH) -> float:
    """0 to 1: the estimated Dice coefficient of two fingerprints' windows; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit("-", 1)[1]), ">u4") for f in (a, b))
    low = np.union1d(x, y)[:size]
    if not len(low):
        return 0.0
    both = len(np.intersect1d(np.intersect1d(low, x), y))
    shared = both / len(low)
    return min(2 * shared / (1 + shared), 1 - 1e-9)


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, guest, id, doc_id, tie, text): buckets in descending id order with the successor of each as a guest."""
    plain = docs.withColumn("id", order_id())
    cuts = sorted({int(x) for x in plain.approxQuantile("id", [k / buckets for k in range(1, buckets)], 0.2 / buckets)},
                  reverse=True) if buckets > 1 else []
    side = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[k:k + side] for k in range(0, len(cuts), side)]
    if groups:  # first the group of cuts, then the cut: the number of cuts above the id
        table = F.array(*[F.array(*map(F.lit, g)) for g in groups])
        full = F.size(F.filter(table, lambda g: F.element_at(g, -1) >= F.col("id")))
        above = full * side + F.coalesce(F.size(F.filter(F.get(table, full), lambda c: c >= F.col("id"))), F.lit(0))
    else:
        above = F.lit(0)
    keyed = plain.withColumn("bucket", above.cast("int")).withColumn("tie", F.xxhash64("text"))
    firsts = sorted(tuple(r) for r in keyed.groupBy("bucket").agg(
        F.max(F.struct("id", F.bitwise_not("tie").alias("t"))).alias("m"))
        .select("bucket", "m.id", F.bitwise_not("m.t")).collect())  # one row per bucket
    spark = docs.sparkSession
    guests = spark.createDataFrame(
        [(i, t, firsts[k - 1][0]) for k, (_, i, t) in enumerate(firsts)], "id bigint, tie bigint, target int")
    both = F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")),
                   F.struct(F.col("target").alias("bucket"), F.lit(True).alias("guest")))
    return (
        keyed.join(F.broadcast(guests), ["id", "tie"], "left")
        .withColumn("at", F.explode(F.when(F.col("target").isNull(), F.slice(both, 1, 1)).otherwise(both)))
        .select("at.bucket", "at.guest", "id", "doc_id", "tie", "text")
    )


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
          ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
          ("common_edited", pa.int64()), ("common_next", pa.int64())]


class _Held:
    """A text with what is computed once from it."""

    def __init__(self, doc_id: int | None, text: str, powers: Powers):
        self.doc_id, self.text = doc_id, text
        self.points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.hashes = PrefixHashes(self.points, powers)
        self.windows = self.hashes.windows()
        self.print = fingerprint_of(self.hashes, smallest(self.windows))


def _compared(a: _Held, b: _Held, powers: Powers) -> tuple:
    n = len(a.points)
    cut = n // 3
    keep = n - cut
    edited = a.text[:keep] + b.text[:cut]
    hashes = PrefixHashes(b.points[:cut], powers, a.hashes, keep)
    windows = np.concatenate([a.windows[:keep], hashes.windows(keep)])  # those that end in the kept part are the same
    told = fingerprint_of(hashes, smallest(windows))
    return (a.doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), a.print, told,
            likeness(a.print, told), likeness(a.print, b.print),
            common_extension(a.hashes, hashes), common_extension(a.hashes, b.hashes))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 buckets: int | None = None) -> DataFrame:
    """The fingerprint of each text, of its edited text, and how near they and the next document are.

    The next document is the next smaller id; after the last comes the first. In
    the edited text the last third (floor) of the code points is replaced by as
    many (or all) from the start of the next text. ``common_edited`` and
    ``common_next`` are the longest common prefixes.

    A null text is empty; an empty text is near another empty one only. Rows
    without an id come first in the descending order; rows with the same id are
    ordered by a hash of their text, and each has its own result row. A single
    row is its own successor. An empty table gives none.
    """
    plain = texts(docs, id_column, text_column)
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{n} {({pa.int64(): 'bigint', pa.string(): 'string', pa.float64(): 'double'})[t]}" for n, t in FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        before, where, rows, done = None, None, [], False
        for batch in batches:
            for bucket, guest, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != where:
                    before, where, done = None, bucket, False
                if done:
                    continue  # an equal guest row
                now = _Held(doc_id, text, powers)
                if before:
                    rows.append(_compared(before, now, powers))
                before, done = now, guest
            if len(rows) >= 256:
                yield told(rows)
                rows = []
        if rows:
            yield told(rows)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)], names=[n for n, _ in FIELDS])

    return (
        bucketed(plain, buckets).repartition("bucket")
        .sortWithinPartitions("bucket", "guest", F.desc("id"), "tie", "text")
        .select("bucket", "guest", "doc_id", "text")
        .mapInArrow(run, schema)
    )


def op3_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints(read(spark, sf, "documents"))
