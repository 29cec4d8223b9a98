"""Secret scans through a trigram inverted index.

A Boolean query of trigrams is derived from each rule's regular expression: what every
match must contain.  Texts are read in blocks; a block gets an inverted index of the
trigrams that occur in the queries (postings are the block's documents), each query
intersects and unites postings, and only the documents that are left are searched with the
rule itself.  A rule without a mandatory trigram (long runs of hexadecimal digits) is
searched in every document.

The index is part of the scan: postings never leave the block, so nothing is shuffled and a
task needs the memory of one block.  Lost tasks are run again.

Defined cases: null and empty texts have no spans; texts of any length are searched whole;
places are code points; repeated rows are repeated in the result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, text_bytes, with_fields

try:  # the parser's module moved in Python 3.11
    from re import _parser as parser
except ImportError:  # pragma: no cover
    import sre_parse as parser

MOST = 64
"""Strings that an exact set may hold; a larger set is replaced by the trigrams of its strings' parts."""


@dataclass(frozen=True)
class Secret:
    """A kind of secret: matches are leftmost and do not overlap; a match whose ``group`` is shorter than ``least`` is dropped."""

    kind: str
    pattern: str
    fold: bool = False
    group: int = 0
    least: int = 0


# fixed values: the three base kinds.  A run of hexadecimal digits is taken whole, so 24 or more of them are asked for in the pattern.
BASE = (
    Secret("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", fold=True, group=2, least=6),
    Secret("access", r"AKIA[A-Z0-9]+", least=20),
    Secret("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Secret("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Secret("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Secret("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Secret("chat_token", r"xox[abprs]-[A-Za-z0-9-]{16,}"),
    Secret("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Secret("pay_key", r"[prs]k_live_[A-Za-z0-9]{16,}"),
    Secret("bearer", r"authorization:\x20*bearer\x20+[A-Za-z0-9._~+/-]{16,}=*", fold=True),
    Secret("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@'\"<>]{1,64}:[^\s/:@'\"<>]{3,64}@[A-Za-z0-9.-]+"),
)

# A query is True (always met), a trigram, or ("and" | "or", set of queries).


def both(x, y):
    if x is True or y is True:
        return x if y is True else y
    parts = frozenset().union(*(q[1] if isinstance(q, tuple) and q[0] == "and" else {q} for q in (x, y)))
    return next(iter(parts)) if len(parts) == 1 else ("and", parts)


def either(queries):
    parts = set(queries)
    if True in parts:
        return True
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def every_trigram(s: str):
    out = True
    for i in range(len(s) - 2):
        out = both(out, s[i : i + 3])
    return out


@dataclass(frozen=True)
class Known:
    """What is known of the strings a part matches: all of them (``exact``), or how they begin and end, and a query that all meet."""

    exact: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    query: object = True


ANY = Known(None, frozenset({""}), frozenset({""}))


def _strings(s: set[str]) -> Known:
    s = frozenset(s)
    return Known(s, s, s)


def _settled(k: Known) -> Known:
    """Exact strings that have grown too many become a query, with what they begin and end with."""
    if k.exact is not None and len(k.exact) <= MOST and all(len(s) <= 40 for s in k.exact):
        return k
    query = k.query
    if k.exact is not None:
        query = both(query, either(every_trigram(s) for s in k.exact))
    begins, ends = {s[:2] for s in k.begins}, {s[-2:] for s in k.ends}
    return Known(None, frozenset(begins) if len(begins) <= MOST else frozenset({""}), frozenset(ends) if len(ends) <= MOST else frozenset({""}), query)


def _then(x: Known, y: Known) -> Known:
    """One part after another."""
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST * 4:
        return _settled(_strings({a + b for a, b in product(x.exact, y.exact)}))
    query = both(x.query, y.query)
    for k in (x, y):
        if k.exact is not None:
            query = both(query, either(every_trigram(s) for s in k.exact))
    if len(x.ends) * len(y.begins) <= MOST * 4:  # trigrams over the seam
        query = both(query, either(every_trigram(a[-2:] + b[:2]) for a, b in product(x.ends, y.begins)))
    begins = {a + b for a, b in product(x.exact, y.begins)} if x.exact is not None and len(x.exact) * len(y.begins) <= MOST else x.begins
    ends = {a + b for a, b in product(x.ends, y.exact)} if y.exact is not None and len(x.ends) * len(y.exact) <= MOST else y.ends
    return _settled(Known(None, frozenset(begins), frozenset(ends), query))


def _one_of(parts: list[Known]) -> Known:
    if all(k.exact is not None for k in parts):
        return _settled(_strings(set().union(*(k.exact for k in parts))))
    query = either(both(k.query, either(every_trigram(s) for s in k.exact)) if k.exact is not None else k.query for k in parts)
    return _settled(Known(None, frozenset().union(*(k.begins for k in parts)), frozenset().union(*(k.ends for k in parts)), query))


def _known(op: str, arg) -> Known:
    """What is known of one parsed node; what is not understood may be anything, which loses no match."""
    if op == "LITERAL":
        return _strings({chr(arg).lower()}) if arg < 128 else ANY
    if op == "IN":
        chars: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < MOST:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return ANY
        return _strings(chars) if len(chars) <= 8 and all(c.isascii() for c in chars) else ANY
    if op == "SUBPATTERN":
        return _sequence(arg[-1])
    if op == "BRANCH":
        return _one_of([_sequence(x) for x in arg[1]])
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, what = arg
        inner = _sequence(what)
        if (least, most) == (0, 1):
            return _one_of([_strings({""}), inner])
        if least == 0:
            return ANY
        out = inner
        for _ in range(min(least, 3) - 1):
            out = _then(out, inner)
        return out if least == most <= 3 else _then(_then(out, ANY), inner) if least > 1 or inner.exact is None else _then(out, ANY)
    if op == "AT":
        return _strings({""})
    return ANY


def _sequence(nodes) -> Known:
    out = _strings({""})
    for op, arg in nodes:
        out = _then(out, _known(str(op), arg))
    return out


def trigram_query(pattern: str):
    """Trigrams, in lower case, that every match contains: ``True`` if there is no mandatory one."""
    k = _sequence(parser.parse(pattern))
    return both(k.query, either(every_trigram(s) for s in k.exact)) if k.exact is not None else k.query


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


class Index:
    """The queries of a rule list and the inverted index of one block at a time."""

    def __init__(self, rules: tuple[Secret, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        # ASCII: letters fold to ASCII letters alone
        self.regexes = [re.compile(r.pattern, re.ASCII | re.IGNORECASE if r.fold else re.ASCII) for r in rules]
        self.grams = sorted(set().union(*map(trigrams_of, self.queries)))
        self.number = {g: i for i, g in enumerate(self.grams)}
        self.table = np.zeros(1 << 24, np.uint16)
        for g, i in self.number.items():
            a, b, c = g.encode()
            self.table[a << 16 | b << 8 | c] = i + 1
        self.lower = np.arange(256, dtype=np.int32)
        self.lower[65:91] += 32

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each trigram the documents of the block that contain it."""
        found = np.zeros((len(self.grams), len(offsets) - 1), bool)
        if len(data) > 2:
            low = self.lower[data]
            which = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(which)
            found[which[at] - 1, np.searchsorted(offsets, at, side="right") - 1] = True
        return found

    def candidates(self, query, postings: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, str):
            return postings[self.number[query]]
        parts = [self.candidates(q, postings) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Spans (start, rule number, end) of each document, sorted."""
        data, offsets = text_bytes(column)
        postings = self.postings(data, offsets)
        texts = column.to_pylist()
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for n, (rule, query, rx) in enumerate(zip(self.rules, self.queries, self.regexes)):
            for i in np.flatnonzero(self.candidates(query, postings)).tolist():
                if texts[i]:
                    out[i] += [(m.start(), n, m.end()) for m in rx.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for spans in out:
            spans.sort()
        return out


@lru_cache(maxsize=4)
def index(rules: tuple[Secret, ...]) -> Index:
    return Index(rules)


def find(docs: DataFrame, rules: tuple[Secret, ...] = BASE + MORE, column: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``secrets``, an array of (kind, start, end) in order of place, then kind as listed.

    A column of ``docs`` named ``secrets`` gives way.
    """
    kept = [c for c in docs.columns if c.lower() != "secrets"]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index(rules)
        for batch in blocks(batches, column):
            spans = [[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in doc] for doc in ix.scan(batch.column(column))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(spans, pa.list_(span))], names=[*kept, "secrets"])

    ddl = with_fields(kept, docs.schema, secrets="array<struct<kind:string,start:bigint,end:bigint>>")
    return docs.select(*kept).mapInArrow(run, ddl)


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every document."""
    kinds = [r.kind for r in BASE]
    found = find(docs.select("doc_id", "text")).drop("text")
    word = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, word), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in kinds], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Secret, ...] = BASE + MORE, column: str = "text", length: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """All documents, every span of a secret replaced by ``mark`` (spans that overlap by one), and the length column, if there is one, set again."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index(rules)
        for batch in blocks(batches, column):
            texts = batch.column(column).to_pylist()
            for i, spans in enumerate(ix.scan(batch.column(column))):
                if spans:
                    parts, at = [], 0
                    for a, _, b in spans:
                        if a >= at:
                            parts += [texts[i][at:a], mark]
                        at = max(at, b)
                    texts[i] = "".join([*parts, texts[i][at:]])
            arrays = [pa.array(texts, batch.schema.field(column).type) if c == column else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    out = docs.mapInArrow(run, docs.schema)
    if length in columns:
        out = out.withColumn(length, F.when(F.col(column).isNotNull(), F.char_length(column).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out
