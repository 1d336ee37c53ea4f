"""Secrets by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what every
match must contain, in lower case. A segment of documents (a bounded slice of an input
partition) gets an inverted index from those trigrams to its rows; postings are intersected
and united as the query says, and only the candidate rows are verified with the expression
itself. A rule that no trigram is mandatory for scans its segment fully. Segments are
independent, so nothing is shuffled and a lost task is simply run again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _tables, row_blocks


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further kinds; each adds spans of its own and takes none from the base.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
#: Alternatives of a literal run that are followed at once.
MOST_STRINGS = 64

# A query is True (anything may match), a trigram, or ("and" | "or", parts).


def trigram_query(pattern: str):
    """The Boolean trigram query that every text with a match of ``pattern`` satisfies."""
    exact, query = _analyse(_parser.parse(pattern))
    return _all([query, _strings_query(exact)])


def _all(parts: list):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: list):
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _strings_query(strings: set[str] | None):
    """One of ``strings`` occurs: the trigrams of each, as alternatives."""
    if not strings:
        return True
    return _any([_all(sorted({s[i:i + 3] for i in range(len(s) - 2)})) for s in sorted(strings)])


def _analyse(nodes) -> tuple[set[str] | None, object]:
    """(all strings that the nodes can match, or None; what else must occur)."""
    run, must, whole = {""}, [], True
    for kind, value in nodes:
        exact, query = _node(kind, value)
        must.append(query)
        if exact is not None:
            joined = {a + b for a in run for b in exact}
            if len(joined) <= MOST_STRINGS:
                run = joined
                continue
        must.append(_strings_query(run))
        run, whole = exact or {""}, False
    return (run, True) if whole else (None, _all([*must, _strings_query(run)]))


def _node(kind, value) -> tuple[set[str] | None, object]:
    if kind is op.LITERAL:
        return ({chr(value).lower()} if value < 128 else None), True
    if kind is op.IN:
        if all(k is op.LITERAL and v < 128 for k, v in value) and len(value) <= 8:
            return {chr(v).lower() for _, v in value}, True
        return None, True
    if kind is op.SUBPATTERN:
        return _analyse(value[-1])
    if kind is op.BRANCH:
        found = [_analyse(branch) for branch in value[1]]
        if all(exact is not None for exact, _ in found):
            strings = set().union(*(exact for exact, _ in found))
            return (strings, True) if len(strings) <= MOST_STRINGS else (None, _strings_query(strings))
        return None, _any([_all([query, _strings_query(exact)]) for exact, query in found])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        exact, query = _analyse(inner)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, True
        if low == high == 1:
            return exact, query
        return None, (_all([query, _strings_query(exact)]) if low else True)
    if kind is op.AT:
        return {""}, True
    return None, True


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


def segment_postings(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, n_wanted: int) -> list[np.ndarray]:
    """For each wanted trigram the ascending rows that hold it. ``wanted`` maps a trigram's
    three bytes to its number plus 1, all others to 0."""
    lower, _ = _tables()
    empty = [np.empty(0, np.int64)] * n_wanted
    if len(data) < 3:
        return empty
    low = lower[data].astype(np.int32)
    number = wanted[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
    at = np.flatnonzero(number)
    rows = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[rows + 1]
    n_rows = len(offsets)
    pairs = np.unique((number[at[inside]].astype(np.int64) - 1) * n_rows + rows[inside])
    cuts = np.searchsorted(pairs, np.arange(n_wanted + 1) * n_rows)
    return [pairs[a:b] - i * n_rows for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]


def candidates(query, postings: dict[str, np.ndarray], n_rows: int) -> np.ndarray:
    """Ascending rows that satisfy ``query``."""
    if query is True:
        return np.arange(n_rows)
    if isinstance(query, str):
        return postings[query]
    parts = [candidates(q, postings, n_rows) for q in query[1]]
    if query[0] == "and":
        parts.sort(key=len)
        found = parts[0]
        for part in parts[1:]:
            found = np.intersect1d(found, part, assume_unique=True)
        return found
    return np.unique(np.concatenate(parts))


def rule_spans(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if len(m.group(rule.group)) >= rule.least]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: id and ``found array<struct<kind, start, end>>``, by start, then rule order.

    Offsets are code points, ends exclusive. Null text counts as empty and has no spans;
    ids may be null or repeated; other columns are ignored. Every text is searched whole. An
    empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    queries = [trigram_query(r.pattern) for r in rules]
    names = sorted(set().union(*(trigrams_of(q) for q in queries)))

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        wanted = np.zeros(1 << 24, np.uint16)
        for i, name in enumerate(names):
            wanted[int.from_bytes(name.encode(), "big")] = i + 1
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in stream:
            for block, data, offsets in row_blocks(batch, text_col):
                postings = dict(zip(names, segment_postings(data, offsets, wanted, len(names))))
                texts = block.column(text_col)
                found: list[list] = [[] for _ in range(block.num_rows)]
                for order, (rule, query, pattern) in enumerate(zip(rules, queries, compiled)):
                    for row in candidates(query, postings, block.num_rows):
                        for start, end in rule_spans(rule, pattern, texts[row].as_py() or ""):
                            found[row].append((start, order, end))
                spans = [[{"kind": rules[o].kind, "start": s, "end": e} for s, o, e in sorted(f)] for f in found]
                yield pa.RecordBatch.from_arrays([block.column(id_col), pa.array(spans, kind)], names=[id_col, "found"])

    return docs.select(id_col, text_col).mapInArrow(
        scan, f"`{id_col}` {id_type}, found array<struct<kind:string,start:bigint,end:bigint>>")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def of_kinds(*kinds):
        return lambda s: s["kind"].isin(*kinds)

    base = [r.kind for r in BASE_RULES]
    found = scan_secrets(docs, id_col, text_col)
    counts = [F.size(F.filter("found", of_kinds(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select(id_col, *counts,
                        F.sha2(joined(F.filter("found", of_kinds(*base))), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"))
