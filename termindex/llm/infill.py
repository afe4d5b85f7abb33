"""Fill-in-the-middle examples by a pyarrow.compute pipeline.

A text is cut into three pieces at two places and written in another order, so that a
model learns to fill in the middle. Each batch is handled as columns: texts become
list arrays of code points over the same bytes; these are flattened beside the index
of their parent; a unit's ordinal is its place less that of its parent's first; the
ordinal gives its role (prefix, middle, suffix); units are filtered by role, the lists
rebuilt, and joined to one piece per text. Long texts go through it in stretches of
about ``STRETCH_BYTES`` whose pieces are joined again, so memory stays near the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex.llm.common import read

MARKS = ("<P>", "<S>", "<M>")  # in front of the prefix, the suffix and the middle
PLAIN_FROM = 90  # of 100: from here on a text stays plain
SPM_BELOW = 20   # of 100: below, the suffix comes first
STRETCH_BYTES = 1 << 20


def units(texts: pa.StringArray) -> pa.ListArray:
    """The code points of each text as a list array over the same bytes."""
    _, borders, data = texts.buffers()
    borders = np.frombuffer(borders, dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    low, high = int(borders[0]), int(borders[-1])
    data = data.slice(low, high - low) if data is not None else pa.py_buffer(b"")
    begins = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80).astype(np.int32)
    ends = np.append(begins, high - low).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), data)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, borders - low).astype(np.int32)), flat)


def stretches(texts: pa.StringArray, limit: int = STRETCH_BYTES) -> Iterator[tuple[int, int, pa.StringArray]]:
    """(row, code points before, texts from that row on) in parts of about ``limit`` bytes; a longer text comes alone, in parts."""
    sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
    row = 0
    while row < len(texts):
        upto = row + max(1, int(np.searchsorted(np.cumsum(sizes[row:row + 65536]), limit, side="right")))
        if sizes[row] <= limit:
            yield row, 0, texts.slice(row, upto - row)
            row = upto
            continue
        data, begin, before = texts[row].as_buffer(), 0, 0
        while begin < data.size:
            end = min(data.size, begin + limit)
            while end < data.size and data[end] & 0xC0 == 0x80:
                end += 1
            part = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, end - begin], dtype=np.int32)), data.slice(begin, end - begin))
            yield row, before, part
            before += pc.utf8_length(part)[0].as_py()
            begin = end
        row += 1


def cut(texts: pa.StringArray, first: np.ndarray, second: np.ndarray, limit: int = STRETCH_BYTES) -> list[pa.StringArray]:
    """Each text up to its ``first`` code point, from there to the ``second``, and the rest."""
    pieces: list[list[pa.Array]] = [[], [], []]
    rows = []
    for row, before, part in stretches(texts, limit):
        lists = units(part)
        flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
        ordinals = pc.subtract(pa.array(np.arange(before, before + len(flat))), pc.take(lists.offsets, parents))
        here = slice(row, row + len(part))
        roles = pc.add(*[pc.greater_equal(ordinals, pc.take(pa.array(border[here]), parents)).cast(pa.int8())
                         for border in (first, second)])
        for role, out in enumerate(pieces):
            mask = pc.equal(roles, role)
            counts = np.bincount(np.asarray(pc.filter(parents, mask)), minlength=len(part))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            out.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(flat, mask)), ""))
        rows.append(np.arange(row, row + len(part)))
    if not rows:
        return [texts, texts, texts]
    # The parts of one text follow each other.
    offsets = pa.array(np.searchsorted(np.concatenate(rows), np.arange(len(texts) + 1)).astype(np.int32))
    return [pc.binary_join(pa.ListArray.from_arrays(offsets, pa.concat_arrays(out)), "") for out in pieces]


def _remainder(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def fill_in_middle(docs: DataFrame, seed: int = 1, marks: tuple[str, str, str] = MARKS, plain_from: int = PLAIN_FROM,
                   spm_below: int = SPM_BELOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row; form is ``plain``, ``psm`` or ``spm``.

    All choices follow from the seed and the id alone, so repeated rows give equal rows; rows without an id count as
    the empty id. A null text is an empty one. Empty texts and texts that hold a mark stay plain: output is the
    text, and the two lengths are null. An empty table gives none. Marks must not overlap each other.
    """
    for one in marks:
        for other in marks:
            if not one or any(one.endswith(other[:k]) for k in range(1, len(other))) or (one != other and other in one):
                raise ValueError(f"marks {one!r} and {other!r} could overlap")
    if len(set(marks)) < 3:
        raise ValueError("marks must differ")
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            n = pc.utf8_length(text).cast(pa.int64())
            drawn = [_remainder(batch.column(k), pc.add(n, 1)) for k in (2, 3)]
            plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_remainder(batch.column(4), pa.scalar(100, pa.int64())), plain_from))
            for mark in marks:
                plain = pc.or_(plain, pc.match_substring(text, mark))
            first, second = pc.min_element_wise(*drawn), pc.max_element_wise(*drawn)
            # Plain texts need no pieces.
            prefix, middle, suffix = cut(pc.if_else(plain, "", text), np.asarray(first), np.asarray(second))
            suffix_first = pc.less(_remainder(batch.column(5), pa.scalar(100, pa.int64())), spm_below)
            output = pc.if_else(suffix_first, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, ""),
                                pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, ""))
            none = pa.scalar(None, pa.int64())
            yield pa.RecordBatch.from_arrays([
                key, n, pc.if_else(plain, "plain", pc.if_else(suffix_first, "spm", "psm")),
                pc.if_else(plain, none, first), pc.if_else(plain, none, pc.subtract(second, first)),
                pc.if_else(plain, text, output)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    key = F.col(f"`{id_column}`").cast("bigint")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"),
                       *[F.conv(F.substring(drawn, 1 + 8 * k, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)])
    return rows.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text behind an output: its pieces lie between the marks, which the text itself does not hold."""
    between = F.split(output, "|".join("\\Q" + mark + "\\E" for mark in marks))
    return (F.when(form == "psm", F.concat(between[1], between[3], between[2]))
            .when(form == "spm", F.concat(between[2], between[3], between[1])).otherwise(output))


def op13_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS varchar), '')) AS h FROM documents),
numbers AS (
  SELECT doc_id, t, length(t)::bigint AS n, ('0x' || h[1:8])::bigint AS h1, ('0x' || h[9:16])::bigint AS h2,
    ('0x' || h[17:24])::bigint AS h3, ('0x' || h[25:32])::bigint AS h4 FROM drawn),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
pieces AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
"""
