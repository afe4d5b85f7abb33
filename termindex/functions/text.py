"""Text expressions: folding, cleaning, tokens and positions.

Everything here is a Column built from Spark's own functions. No shuffle, no
Python: a text is cleaned, cut and positioned inside the row that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latin_except(chars: str) -> str:
    """Class of all Latin-1 characters but the given ones, spelled as ranges.

    Java tests such a class with a bit set; a negated class is several times
    slower. Texts are folded to ASCII first, so nothing lies outside it.
    """
    ranges, low = "", 0
    for code in sorted({ord(c) for c in chars}) + [256]:
        if code > low:
            ranges += f"\\x{low:02X}-\\x{code - 1:02X}"
        low = code + 1
    return f"[{ranges}]"


def _literal(opening: str, body: str, escaped: bool = True) -> str:
    """Opening, then anything of ``body``, or a backslash with the character after it."""
    return f"{opening}{body}*+" + (rf"(?:\\[\s\S]{body}*+)*+" if escaped else "")


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_"

# Patterns. The loops are possessive, so a long literal or
# comment neither backtracks nor deepens the matcher's stack.
NON_ASCII = r"[^\x00-\x7F]"
IDENT = r"[A-Za-z_][A-Za-z0-9_]*+"
SCOPED = r"[A-Za-z_][A-Za-z0-9_:]*+"
WORD = r"[A-Za-z0-9_]++"
TILE = f"{IDENT}|{latin_except(LETTERS)}++"

DOUBLE_QUOTED = _literal('"', latin_except('"\\\n')) + '"?'
SINGLE_QUOTED = _literal("'", latin_except("'\\")) + "'"
LINE_COMMENT = _literal("//", latin_except("\\\n"))
BLOCK_COMMENT = rf"/\*{latin_except('*')}*+(?:\*(?!/){latin_except('*')}*+)*+\*/"
TRIPLE_DOUBLE = f'"{{3}}{latin_except(chr(34))}*+(?:"(?!""){latin_except(chr(34))}*+)*+"{{3}}'
TRIPLE_SINGLE = f"'{{3}}{latin_except(chr(39))}*+(?:'(?!''){latin_except(chr(39))}*+)*+'{{3}}"
PY_DOUBLE = _literal('"', latin_except('"\\\n')) + '"'
PY_SINGLE = _literal("'", latin_except("'\\\n")) + "'"
HASH_COMMENT = _literal("#", latin_except("\n"), escaped=False)
MARKUP_COMMENT = f"<!--{latin_except('-')}*+(?:-(?!->){latin_except('-')}*+)*+-->"
MARKUP_STRING = _literal('"', latin_except('"'), escaped=False) + '"'

CLIKE = "|".join([DOUBLE_QUOTED, SINGLE_QUOTED, LINE_COMMENT, BLOCK_COMMENT])
PYTHON = "|".join([TRIPLE_DOUBLE, TRIPLE_SINGLE, PY_DOUBLE, PY_SINGLE, HASH_COMMENT])
INCLUDE_LINE = rf"\n[ \t]*+#[ \t]*+include{latin_except(chr(10))}*+"

# Characters that are escaped in names.
ESCAPED = r"([.*^$/\\~\[\]])"


def ascii_fold(text: Column | str) -> Column:
    """Each non-ASCII code point becomes ``?``."""
    return F.regexp_replace(text, NON_ASCII, "?")


def strip_clike(text: Column | str) -> Column:
    """Remove C-style comments, strings and character literals from the folded text."""
    return F.regexp_replace(ascii_fold(text), CLIKE, "")


def strip_python(text: Column | str) -> Column:
    """Remove Python comments and string literals from the folded text."""
    return F.regexp_replace(ascii_fold(text), PYTHON, "")


def strip_includes(text: Column | str) -> Column:
    """Remove ``#include`` lines except on the first line from the folded text (P5)."""
    return F.regexp_replace(ascii_fold(text), INCLUDE_LINE, "")


def squeeze_blank(text: Column | str) -> Column:
    """No empty lines, no blanks at a line start, no two blanks in a row."""
    lines = F.regexp_replace(text, r"\n[ \t\n]++", "\n")
    return F.regexp_replace(lines, r"([ \t])[ \t]++", "$1")


def strip_code(text: Column | str, family: str, layout: bool = True) -> Column:
    """The whole cleaning of one comment family: ``clike`` or ``python``.

    The text is folded once. Without ``layout`` blanks stay as they are, which
    changes no word.
    """
    if family == "clike":
        stripped = F.regexp_replace(strip_clike(text), INCLUDE_LINE, "")
    elif family == "python":
        stripped = strip_python(text)
    else:
        raise ValueError(f"unknown comment family {family!r}")
    return squeeze_blank(stripped) if layout else stripped


def escape_name(name: Column | str) -> Column:
    """Put a backslash before pattern metacharacters."""
    return F.regexp_replace(name, ESCAPED, r"\\$1")


def words(text: Column | str, mode: str = "ident") -> Column:
    """Array of the words of a text, in order, with repeats (K1, K2, K3)."""
    if mode == "ident":
        return F.regexp_extract_all(text, F.lit(IDENT), F.lit(0))
    if mode == "word":
        return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    if mode == "scoped":
        whole = F.regexp_extract_all(text, F.lit(SCOPED), F.lit(0))
        pairs = F.transform(whole, lambda w: F.when(
            F.contains(w, F.lit(":")), F.array(w, F.regexp_replace(w, "^[^:]*:", "")),
        ).otherwise(F.array(w)))
        return F.filter(F.flatten(pairs), lambda w: w != "")
    raise ValueError(f"unknown token mode {mode!r}")


def starts_word(piece: str) -> Column:
    """Whether a piece begins like an identifier, by its first character code."""
    return F.expr(f"ascii({piece}) BETWEEN 65 AND 90 OR ascii({piece}) BETWEEN 97 AND 122 "
                  f"OR ascii({piece}) = 95")


def with_starts(df: DataFrame, lengths: str, starts: str) -> DataFrame:
    """Running sums of an array of lengths: where each piece starts.

    The sums are taken inside blocks and then over the blocks. Appending to an
    array copies it, so the block size grows with the cube root of the number of
    pieces: the work stays near n^(4/3) up to the largest text a row can hold,
    and nothing is shuffled. Each step is its own projection because Catalyst
    keeps an expression apart when a later step reads it twice.
    """
    start = "named_struct('off', 0L, 'seen', CAST(array() AS array<bigint>))"
    step = "named_struct('off', s.off + n, 'seen', array_append(s.seen, s.off))"
    return (
        df
        .withColumn("_size", F.expr(f"CAST(greatest(64, cbrt(2 * size({lengths}))) AS int)"))
        .withColumn("_blocks", F.expr(
            f"transform(sequence(0, greatest(size({lengths}) - 1, 0) div _size), "
            f"b -> aggregate(slice({lengths}, CAST(b * _size + 1 AS int), _size), {start}, (s, n) -> {step}))"))
        .withColumn("_bases", F.expr(
            f"aggregate(transform(_blocks, b -> b.off), {start}, (s, n) -> {step}, s -> s.seen)"))
        .withColumn(starts, F.expr(
            "flatten(zip_with(_blocks, _bases, (b, o) -> transform(b.seen, x -> x + o)))"))
        .drop("_size", "_blocks", "_bases")
    )


def tiled(df: DataFrame, text: str, pattern: str,
          pieces: str = "_piece", starts: str = "_start") -> DataFrame:
    """Add two parallel arrays: the matches of ``pattern`` and their start offsets.

    ``pattern`` must match every character of the folded text. Folding keeps
    the number of characters, so the offsets are those of the text itself.
    """
    cut = (df.withColumn(pieces, F.regexp_extract_all(ascii_fold(text), F.lit(pattern), F.lit(0)))
           .withColumn("_len", F.expr(f"transform({pieces}, p -> CAST(length(p) AS bigint))")))
    return with_starts(cut, "_len", starts).drop("_len")
