"""Secret scans by combined automata.

The three base rules and the heads of all added rules are compiled into one
minimal deterministic automaton that reads each byte of a text once. The added
rules, with their long tails, are compiled whole into a second one, which reads
the lines that hold a head: in one automaton the tails would multiply the states
of all other rules (39,937 instead of 472 and 3,189). Where a rule stops
accepting, a longest candidate ends; the automaton of the reversed rule finds
its start, never before the match before, so the time is in proportion to the
text. Texts of a batch are joined with line ends between them and cut into lanes
at bytes that reset the automaton, so one array operation moves all lanes by one
byte. Memory depends on the batch and its longest text only. The automata are
compiled once, on the driver.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex.llm.automaton import (Dfa, Node, accepting_ends, alt, cls, compile_rules, backwards, earliest_start, lit, opt,
                                     plus, seq, star)
from termindex.llm.common import read, texts

ALNUM = (string.ascii_letters + string.digits).encode()
UPPER_DIGITS = (string.ascii_uppercase + string.digits).encode()
VALUE = ALNUM + b"+/_.=-"
NAME = ALNUM + b"_-"
QUOTE, SPACES = opt(cls(b"\"'")), star(cls(b" "))


@dataclass(frozen=True)
class Rule:
    """``node`` is what the rule recognises, longest and leftmost.

    ``value``: the group that must have ``least`` characters, matched on the span.
    ``head``: what every match begins with; such rules read only lines that hold a head.
    ``closes``: the kind of rule whose matches this one ends; it gives no spans of its own.
    """

    kind: str
    node: Node
    least: int
    value: str | None = None
    head: Node | None = None
    closes: str | None = None


ASSIGN_WORDS = alt(*[lit(w, any_case=True) for w in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")])
HEX = cls(b"0123456789abcdef")
WORDLIKE = plus(cls(ALNUM + b"_-"))


def headed(kind: str, head: Node, tail: Node, least: int, closes: str | None = None) -> Rule:
    return Rule(kind, seq(head, tail), least, head=head, closes=closes)


KEY_LABEL = seq(star(cls(string.ascii_uppercase.encode() + b" ")), lit(b"PRIVATE KEY-----"))
RULES = [
    Rule("assign", seq(ASSIGN_WORDS, QUOTE, SPACES, cls(b":="), SPACES, QUOTE, plus(cls(VALUE))), 12,
         r"""^(?:[A-Za-z_]+)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)$"""),
    Rule("access", seq(lit(b"AKIA"), plus(cls(UPPER_DIGITS))), 18),
    Rule("hex", seq(*[HEX] * 15, plus(HEX)), 16),
    headed("github", seq(lit(b"gh"), cls(b"pousr"), lit(b"_")), plus(cls(ALNUM)), 40),
    headed("slack", seq(lit(b"xox"), cls(b"abprs"), lit(b"-")), plus(cls(ALNUM + b"-")), 15),
    headed("google", lit(b"AIza"), WORDLIKE, 39),
    headed("stripe", seq(alt(lit(b"sk"), lit(b"rk")), lit(b"_live_")), plus(cls(ALNUM)), 24),
    headed("jwt", lit(b"eyJ"), seq(WORDLIKE, lit(b".eyJ"), WORDLIKE, lit(b"."), WORDLIKE), 30),
    headed("bearer", lit(b"bearer ", any_case=True), plus(cls(VALUE)), 27),
    headed("key_block", lit(b"-----BEGIN "), KEY_LABEL, 27),
    headed("key_end", lit(b"-----END "), KEY_LABEL, 25, closes="key_block"),
]
KEY_BODY = ALNUM + b"+/=:,\\- \t\r\n"  # a key in armour, its header lines too; backslashes where it stands in a literal
BASE = ("assign", "access", "hex")


class Scanner:
    """The compiled rules."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.whole = [r for r, rule in enumerate(rules) if rule.head is None]
        self.headed = [r for r, rule in enumerate(rules) if rule.head is not None]
        heads = [alt(*[rules[r].head for r in self.headed])] if self.headed else []
        self.forward = compile_rules([rules[r].node for r in self.whole] + heads, anywhere=True)
        self.second = compile_rules([rules[r].node for r in self.headed], anywhere=True) if self.headed else None
        self.reverse = [compile_rules([backwards(r.node)], anywhere=False) for r in rules]
        self.values = [re.compile(r.value.encode()) if r.value else None for r in rules]
        if not (self.forward.resets[10] and (self.second is None or self.second.resets[10])):
            raise ValueError("a rule reads across line ends, where texts are cut")

    def candidates(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, rule number) of the longest candidates, by end."""
        def read(dfa: Dfa, data: np.ndarray, rules: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            cuts = np.concatenate([[0], np.flatnonzero(dfa.resets[data]) + 1])
            ends, masks = accepting_ends(dfa, data, cuts)
            held = [np.flatnonzero(masks >> k & 1) for k in range(len(rules))]
            head = ends[masks >> len(rules) & 1 > 0]
            return (np.concatenate([ends[at] for at in held]),
                    np.repeat(np.array(rules, dtype=np.int64), [len(at) for at in held]), head)

        ends, numbers, heads = read(self.forward, data, self.whole)
        if len(heads):
            lines = np.concatenate([[0], np.flatnonzero(data == 10) + 1])  # the last one is empty
            line = np.unique(np.searchsorted(lines, heads - 1, side="right") - 1)
            lengths = lines[line + 1] - lines[line]
            begins = np.cumsum(lengths) - lengths
            more, of, _ = read(self.second, np.concatenate([data[lines[k]:lines[k + 1]] for k in line]), self.headed)
            k = np.searchsorted(begins, more - 1, side="right") - 1
            ends, numbers = np.concatenate([ends, lines[line[k]] + more - begins[k]]), np.concatenate([numbers, of])
        order = np.lexsort([numbers, ends])
        return ends[order], numbers[order]

    def spans(self, batch: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
        """For each text its (start, rule number, end) in bytes, by start, then rule number."""
        ends, numbers = self.candidates(np.frombuffer(b"\n".join(batch) + b"\n", dtype=np.uint8))
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in batch])])
        bounds = np.searchsorted(ends, first, side="right")
        for i, text in enumerate(batch):
            found, past = [], [0] * len(self.rules)
            at = slice(bounds[i], bounds[i + 1])
            for end, r in zip((ends[at] - first[i]).tolist(), numbers[at].tolist(), strict=True):
                begin = earliest_start(self.reverse[r], text, end, past[r])
                if begin < 0:
                    continue  # it would overlap the match before
                past[r] = end
                value = self.values[r].match(text[begin:end]) if self.values[r] else None
                if (end - begin if value is None else value.end(1) - value.start(1)) >= self.rules[r].least:
                    found.append((begin, r, end))
            yield self.closed(text, sorted(found))

    def closed(self, text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Matches of rules that others close reach to the next such end, if only a key's characters lie between."""
        out: list[tuple[int, int, int]] = []
        opened: dict[str, int] = {}  # kind: place in out of the last one that is still open
        for begin, r, end in found:
            rule = self.rules[r]
            if not rule.closes:
                opened[rule.kind] = len(out)
                out.append((begin, r, end))
            elif (k := opened.pop(rule.closes, None)) is not None:
                start, of, stop = out[k]
                label = text[start:stop].split(b" ", 1)[1]
                if text[begin:end].split(b" ", 1)[1] == label and not text[stop:begin].translate(None, KEY_BODY):
                    out[k] = (start, of, end)
        return out


@functools.cache
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(list(rules))


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 rules: list[Rule] | None = None, batch_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, spans): per row its array<struct<kind, start, end>> in code points, end exclusive.

    Within a kind matches are leftmost and do not overlap; a match that is too
    short still uses up its text. Spans are ordered by start, then by the order
    of the rules. A ``key_block`` reaches from its BEGIN to its END line; without one, it is the BEGIN line.
    A null or empty text has no spans. Each row is scanned by
    itself, so repeated rows, ties and null ids need no rule; an empty table
    gives none. Whole texts are scanned, of any length.
    """
    rules = rules or RULES
    scanner = compiled(tuple(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(ids: list, held: list[bytes]) -> pa.RecordBatch:
            out = []
            for text, found in zip(held, scanner.spans(held), strict=True):
                points = lambda at, text=text: at if text.isascii() else len(text[:at].decode())
                out.append([{"kind": rules[r].kind, "start": points(b), "end": points(e)} for b, r, e in found])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, kind)], ["doc_id", "spans"])

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        ids, held, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(key)
                held.append(text.as_buffer().to_pybytes())
                size += len(held[-1])
                if size >= batch_bytes:
                    yield told(ids, held)
                    ids, held, size = [], [], 0
        if ids:
            yield told(ids, held)

    return texts(docs, id_column, text_column).mapInArrow(
        run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def _told(spans, kinds=None):
    held = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(held, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return scan_secrets(read(spark, sf, "documents")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_told(F.col("spans"), BASE), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """The three base kinds by regular expressions: the contract as written, for tests."""
    out = []
    word = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    for k, (kind, pattern, group, least) in enumerate([
            ("assign", word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
            ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [(kind, b, e) for b, _, kind, e in sorted(out)]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{b}:{e}" for k, b, e in spans).encode()).hexdigest()
