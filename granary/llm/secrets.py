"""Secret scans through a trigram inverted index.

Each regex is turned into a Boolean query over trigrams that any match must contain. Every block of
documents gets an inverted index (posting bitmaps for the trigrams that the queries mention, built in
one vectorised pass over its bytes); postings are intersected and united as the query says and only
the candidates left are verified with the regex. A rule without mandatory trigrams (long hexadecimal
runs) scans every document. Blocks are independent, so the scan needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release, slices

try:
    from re import _constants as sre, _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters; ``run`` is a byte class of which every match has ``least`` in a row."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False
    run: bytes = b""

    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24, run=b"0123456789abcdef"),
)
#: Published token formats; they add spans to the base ones.
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
SPANS = "array<struct<kind:string,start:int,end:int>>"
_MOST_STRINGS = 64

# A query is a frozenset of frozensets of trigrams: an OR of ANDs. The empty AND holds for every document.
Query = frozenset
ALL: Query = frozenset([frozenset()])


def _simple(query) -> Query:
    """Drops alternatives that a weaker one covers; too many alternatives mean ALL."""
    kept = [a for a in query if not any(b < a for b in query)]
    return frozenset(kept) if len(kept) <= _MOST_STRINGS else ALL


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > 4 * _MOST_STRINGS:
        return a if len(a) < len(b) else b
    return _simple({x | y for x in a for y in b})


def _of_strings(strings: set[str]) -> Query:
    return _simple({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _class_members(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
        if len(out) > 8:
            return None
    return out


def _walk(parsed) -> tuple[set[str] | None, Query]:
    """(all strings the part can match, if they are few; a query that every match satisfies)."""
    query, run, exact = ALL, {""}, True

    def add(strings: set[str]) -> None:
        nonlocal run, query
        joined = {a + b for a in run for b in strings}
        if len(joined) > _MOST_STRINGS:
            cut()
            joined = strings
        run = joined

    def cut() -> None:
        nonlocal run, query, exact
        query, run, exact = _both(query, _of_strings(run)), {""}, False

    for op, arg in parsed:
        if op is sre.LITERAL:
            add({chr(arg).lower()})
        elif op is sre.IN and (members := _class_members(arg)):
            add(members)
        elif op is sre.AT:
            continue
        elif op is sre.SUBPATTERN or op is sre.BRANCH:
            parts = [_walk(arg[-1])] if op is sre.SUBPATTERN else [_walk(p) for p in arg[1]]
            if all(p[0] is not None for p in parts):
                add(set().union(*(p[0] for p in parts)))
            else:
                cut()
                query = _both(query, _simple(reduce(frozenset.union, (p[1] if p[0] is None else _of_strings(p[0]) for p in parts))))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            strings, inner = _walk(sub)
            if strings is not None and (low, high) == (0, 1):
                add(strings | {""})
            else:
                cut()
                if low:
                    query = _both(query, inner if strings is None else _of_strings(strings))
        else:
            cut()
    if exact:
        return run, _of_strings(run)
    return None, _both(query, _of_strings(run))


def trigram_query(rule: Rule) -> Query:
    """OR of ANDs of lower-case trigrams that every match contains; ``ALL`` if there are none."""
    return _walk(sre_parse.parse(rule.pattern))[1]


class Scanner:
    """Compiled rules with the trigrams to index. Built once in each Python worker."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.regex(), trigram_query(r)) for r in rules]
        grams = sorted({g.encode() for _, _, q in self.rules for a in q for g in a if g.isascii()})
        if len(grams) > 250:
            raise ValueError("the rules mention more than 250 trigrams")
        self.column = {g.decode(): i for i, g in enumerate(grams)}
        self.slot = np.zeros(1 << 24, np.uint8)
        for i, g in enumerate(grams):
            self.slot[g[0] << 16 | g[1] << 8 | g[2]] = i + 1
        self.members = {r.run: np.isin(np.arange(256), np.frombuffer(r.run.lower(), np.uint8)) for r in rules if r.run}

    def postings(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block's inverted index as bitmaps (document by trigram), its bytes, and where documents start."""
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        starts = np.cumsum([0] + [len(r) + 1 for r in raw])
        data = np.frombuffer(b"\xff".join(raw) + b"\xff\xff\xff", np.uint8)
        index = np.zeros((len(texts), len(self.column) + 1), bool)
        for at in range(0, len(data) - 2, 1 << 20):  # the code array stays small however long one text is
            part = data[at : at + (1 << 20) + 2].astype(np.int32)
            slots = self.slot[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            where = np.flatnonzero(slots)
            index[np.searchsorted(starts, where + at, "right") - 1, slots[where]] = True
        return index[:, 1:], data, starts

    def candidates(self, query: Query, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index), bool)
        for grams in query:
            hit = np.ones(len(index), bool)
            for g in grams:
                if g in self.column:
                    hit &= index[:, self.column[g]]
            out |= hit
        return out

    def with_runs(self, rule: Rule, data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """Documents that can hold ``least`` bytes of the class in a row: every eighth byte is enough to tell."""
        step = max(1, rule.least // 3)
        seen = self.members[rule.run][data[::step]]
        hits = np.flatnonzero(seen[:-2] & seen[1:-1] & seen[2:]) if len(seen) > 2 else np.array([], int)
        out = np.zeros(n, bool)
        for shift in (0, step, 2 * step):
            at = np.searchsorted(starts, hits * step + shift, "right") - 1
            out[at[at < n]] = True
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """The spans of each text, by start and then in the order of the rules."""
        index, data, starts = self.postings(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, regex, query) in enumerate(self.rules):
            if query != ALL:
                among = self.candidates(query, index)
            elif rule.run and rule.least >= 6 and len(data):
                among = self.with_runs(rule, data, starts, len(texts))
            else:
                among = np.ones(len(texts), bool)
            for i in np.flatnonzero(among):
                for m in regex.finditer(texts[i]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        return [[(self.rules[k][0].kind, a, b) for a, k, b in sorted(spans)] for spans in found]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row (id, ``spans``) per input row: kind, start and end (exclusive) in code points.

    A null or empty text has no spans; repeated rows each get their row; an empty table gives an empty
    one. Other columns are not read, so their names cannot clash.
    """
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch, 1, 1 << 22):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in scanner.scan([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], [id_col, "spans"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, spans {SPANS}")


def redact_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span of its text replaced by ``[kind]``; all rows and other columns stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in slices(batch, at, 1 << 22):
                texts = part.column(at).to_pylist()
                spans = scanner.scan([t or "" for t in texts])
                done = [t if t is None else redacted(t, s) for t, s in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(done, batch.column(at).type) if i == at else c for i, c in enumerate(part.columns)], schema=batch.schema)
        release()

    return docs.mapInArrow(run, docs.schema)
