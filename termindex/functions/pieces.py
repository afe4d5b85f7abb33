"""Words and gaps of batches of texts, cut as arrays of bytes.

For every occurrence of a corpus a pattern is too slow: it makes a string of
each word and each gap. Here a batch of texts is one run of bytes, its pieces
are slices of that run, and strings are made of the wanted ones only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from termindex.functions.text import LETTERS

BLOCK_BYTES = 2 * 1024 * 1024  # texts cut at once; a longer text is cut alone
OUT_ROWS = 128 * 1024  # occurrences written at once
AROUND = {"gap_before": -1, "word_before": -2, "gap_after": 1, "word_after": 2}
LETTER, DIGIT = 1, 2
CLASSES = np.zeros(256, np.uint8)
CLASSES[[ord(c) for c in LETTERS]] = LETTER
CLASSES[[ord(c) for c in "0123456789"]] = DIGIT


class Wanted(NamedTuple):
    """Which names are wanted in texts of which filetype: 0 not, 1 always, 2 and more after a word of ``words``."""

    filetypes: pa.Array
    names: pa.Array
    words: pa.Array
    codes: np.ndarray  # a row for each filetype and an empty one for all others

    @staticmethod
    def of(table: pa.Table) -> Wanted:
        """From (filetype, name, after); a null ``after`` asks for nothing, a null key equals none."""
        table = table.filter(pc.and_(table["filetype"].is_valid(), table["name"].is_valid()))
        columns = [table[c].combine_chunks().cast(pa.string()) for c in ("filetype", "name", "after")]
        filetypes, names, words = (pc.unique(c.drop_null()) for c in columns)
        at = tuple(_places(c, v) for c, v in zip(columns[:2], (filetypes, names)))
        code = _places(columns[2], words) + 2
        codes = np.zeros((len(filetypes) + 1, len(names)), np.int32)
        codes[at] = code
        differs = codes[at] != code
        codes[at[0][differs], at[1][differs]] = 1
        return Wanted(filetypes, names, words, codes)


def _places(values: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each value stands among the known ones, or -1."""
    return pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy(zero_copy_only=False)


def blocks(bounds: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``size`` bytes, or of one text."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield first, last
        first = last


def folded(chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 texts with ``?`` for each non-ASCII code point, and where they start then."""
    if chars.max() < 0x80:
        return chars, starts
    follows = (chars & 0xC0) == 0x80
    starts = starts - np.searchsorted(np.flatnonzero(follows), starts)
    chars = chars[~follows]
    chars[chars >= 0x80] = ord("?")
    return chars, starts


def words_and_gaps(chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece starts, and whether it is a word; texts without characters have no pieces.

    A word is a letter and all letters and digits behind it; digits before it
    belong to the gap. So a digit is what the character before its run is.
    """
    heads = np.zeros(len(chars), bool)
    heads[starts[starts < len(chars)]] = True
    classes = CLASSES[chars]
    word = classes == LETTER
    digits = np.flatnonzero(classes == DIGIT)
    if digits.size:
        begins = heads[digits]
        begins[0] = True
        begins[1:] |= np.diff(digits) != 1
        at = digits[begins]
        lengths = np.diff(np.append(np.flatnonzero(begins), digits.size))
        word[digits] = np.repeat(word[at - 1] & ~heads[at], lengths)
    heads[1:] |= word[1:] != word[:-1]
    pieces = np.flatnonzero(heads)
    return pieces, word[pieces]


def occurrences_in(batch: pa.RecordBatch, context: bool, wanted: Wanted | None) -> Iterator[pa.RecordBatch]:
    """The identifiers of a batch whose last column is the text, with the other columns of its rows."""
    *kept, text = batch.columns
    if text.null_count:
        text = pc.fill_null(text, "")
    text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    if data is None:
        return
    filetypes = None if wanted is None else _places(
        batch.column(batch.schema.get_field_index("filetype")).cast(pa.string()), wanted.filetypes)
    bounds = np.frombuffer(offsets, np.int64, len(text) + 1, 8 * text.offset)
    for first, last in blocks(bounds, BLOCK_BYTES):
        low, high = int(bounds[first]), int(bounds[last])
        if low == high:
            continue
        chars, starts = folded(np.frombuffer(data, np.uint8, high - low, low), bounds[first:last] - low)
        at, is_word = words_and_gaps(chars, starts)
        ends = np.append(at[1:], len(chars))
        pieces = pa.StringArray.from_buffers(
            len(at), pa.py_buffer(np.append(at, len(chars)).astype(np.int32)), pa.py_buffer(chars))
        if wanted is not None:
            name = _places(pieces, wanted.names)
            is_word &= name >= 0
        found = np.flatnonzero(is_word)
        # Which text each occurrence is of, and the pieces that text begins and ends with.
        per_text = np.diff(np.append(np.searchsorted(at[found], starts), found.size))
        rows = np.repeat(np.arange(first, last), per_text)
        borders = np.append(np.searchsorted(at, starts), len(at))
        lowest, beyond = np.repeat(borders[:-1], per_text), np.repeat(borders[1:], per_text)
        shift = np.repeat(starts, per_text)
        if wanted is not None:
            code = wanted.codes[filetypes[rows], name[found]]
            keep = code == 1
            tied = np.flatnonzero(code > 1)
            before = found[tied] - 2
            word = pieces.take(pa.array(before, mask=before < lowest[tied]))
            keep[tied] = pc.fill_null(pc.equal(word, wanted.words.take(pa.array(code[tied] - 2))), False).to_numpy(
                zero_copy_only=False)
            found, rows, lowest, beyond, shift = (a[keep] for a in (found, rows, lowest, beyond, shift))
        for cut in range(0, found.size, OUT_ROWS):
            part = slice(cut, cut + OUT_ROWS)
            here, row = found[part], pa.array(rows[part])
            columns = [c.take(row) for c in kept]
            columns += [pieces.take(pa.array(here)), pa.array(at[here] - shift[part])]
            for step in AROUND.values() if context else ():
                near = here + step
                outside = (near < lowest[part]) | (near >= beyond[part])
                columns.append(pieces.take(pa.array(near, mask=outside)))
            columns.append(pa.array(ends[here] - shift[part]))
            labels = [*batch.schema.names[:-1], "name", "start", *(AROUND if context else ()), "end"]
            yield pa.RecordBatch.from_arrays(columns, names=labels)
