"""Secret scan over a trigram inverted index.

From each rule's regular expression follows a Boolean query over trigrams that every match must
hold. Each Arrow batch is a segment with posting lists (trigram -> rows); the query intersects and
unites postings, and the regular expression then runs on the candidate rows alone. A rule without
mandatory trigrams scans every row. Segments never meet, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as sre_parse
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _LOWER, utf8
from .shared import small_batches


class Rule(NamedTuple):
    """A kind of secret: the expression, the group whose length counts, and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = re.ASCII


#: The first three are fixed by the contract, in this order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting_token", r"gh[opsu]_[A-Za-z0-9]{36,255}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("payment_key", r"sk_live_[A-Za-z0-9]{24,99}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES
MOST_STRINGS = 64

#: A private key from its BEGIN line through the END line of the same kind; without one, through its base64 lines.
_KEY = (
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----"
    r"""|(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:[\s"'+,;>#*|\\]*+[A-Za-z0-9+/=]{16,}+|[ \t\r]*+\n[ \t]*+[A-Za-z0-9+/=]++(?=[ \t\r]*+(?:\n|\Z)))*+)"""
)
#: What is replaced in a text goes to the secret's end, where the scan's spans stop at a header or a greatest length.
WHOLE = {"private_key": _KEY, "hosting_token": r"gh[opsu]_[A-Za-z0-9]{36,}", "chat_token": r"xox[abprs]-[A-Za-z0-9-]{10,}", "payment_key": r"sk_live_[A-Za-z0-9]{24,}", "cloud_key": r"AIza[A-Za-z0-9_-]{35,}"}
WHOLE_RULES = tuple(r._replace(pattern=WHOLE.get(r.kind, r.pattern)) for r in RULES)

# ---- trigram queries ----------------------------------------------------------------------------
# A query is True (no condition), a trigram, ("and", parts) or ("or", parts).


def _all(parts) -> object:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts) -> object:
    parts = list(parts)
    if any(p is True for p in parts):
        return True
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> object:
    """Some string of the set is in the text."""
    return _any(_all(sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in sorted(strings))


def _exact(op, arg) -> set[str] | None:
    """All strings that the node can match, lower-cased, where they are few; else None."""
    if op is sre.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is sre.IN:
        found: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL and x < 128:
                found.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] < 128 and x[1] - x[0] < 12:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= 12 else None
    if op is sre.BRANCH:
        parts = [_exact_all(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is sre.SUBPATTERN:
        return _exact_all(arg[3])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 3:
        one = _exact_all(arg[2])
        if one is None:
            return None
        found, run = set(), {""}
        for n in range(arg[1] + 1):
            if n >= arg[0]:
                found |= run
            run = {a + b for a in run for b in one}
            if len(run) > MOST_STRINGS:
                return None
        return found
    return None


def _exact_all(nodes) -> set[str] | None:
    found = {""}
    for op, arg in nodes:
        one = _exact(op, arg)
        if one is None or len(found) * len(one) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in one}
    return found


def _query(nodes) -> object:
    parts, run = [], {""}
    for op, arg in nodes:
        one = _exact(op, arg)
        if one is not None and len(one) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        parts.append(_of_strings(run))
        run = one if one is not None else {""}
        if one is None:
            if op is sre.SUBPATTERN:
                parts.append(_query(arg[3]))
            elif op is sre.BRANCH:
                parts.append(_any(_query(x) for x in arg[1]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                parts.append(_query(arg[2]))
    return _all([*parts, _of_strings(run)])


def trigram_query(pattern: str, flags: int = re.ASCII) -> object:
    """What every match's lower-cased text must hold; True where nothing follows."""
    return _query(sre_parse.parse(pattern, flags))


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


# ---- segments -----------------------------------------------------------------------------------


class Index:
    """Posting lists of one segment for the trigrams that the rules ask for."""

    def __init__(self, column: pa.Array, wanted: list[str]):
        raw, bounds = utf8(column)
        self.rows = len(bounds) - 1
        self.postings = {t: np.zeros(0, np.int64) for t in wanted}
        if len(raw) < 3 or not wanted:
            return
        codes = {t: int.from_bytes(t.encode(), "big") for t in wanted}
        number = np.zeros(1 << 24, np.uint8)
        for i, t in enumerate(wanted):
            number[codes[t]] = i + 1
        for low in range(0, len(raw), 1 << 20):  # a chunk overlaps the next by two bytes
            part = _LOWER[raw[low : low + (1 << 20) + 2]].astype(np.uint32)
            hit = number[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]] if len(part) > 2 else np.zeros(0, np.uint8)
            at = np.flatnonzero(hit)
            kinds, at = hit[at], at + low
            row = np.searchsorted(bounds, at, "right") - 1
            keep = at + 3 <= bounds[row + 1]  # not across two rows
            kinds, row = kinds[keep], row[keep]
            for i in np.unique(kinds):
                t = wanted[i - 1]
                self.postings[t] = np.union1d(self.postings[t], row[kinds == i])

    def rows_for(self, query: object) -> np.ndarray:
        """Rows that satisfy the query, in order."""
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.postings[query]
        found = [self.rows_for(q) for q in query[1]]
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


class Scanner:
    """Spans (kind number, start, end) by row of a text column, found through the index."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.wanted = sorted(set().union(*map(trigrams_of, self.queries)))
        if len(self.wanted) > 254:
            raise ValueError("a rule set may ask for 254 trigrams at most")
        self.compiled = [re.compile(r.pattern, r.flags) for r in rules]
        # a run of a class that is too short fails anyway, so the run's least length goes into the search
        for k, r in enumerate(rules):
            if r.group == 0 and r.least and re.fullmatch(r"\[[^\]]+\]\+", r.pattern):
                self.compiled[k] = re.compile(r.pattern[:-1] + f"{{{r.least},}}", r.flags)

    def __call__(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        index = Index(column, self.wanted)
        texts = column.to_pylist()
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query, expr) in enumerate(zip(self.rules, self.queries, self.compiled, strict=True)):
            for row in index.rows_for(query):
                if text := texts[row]:
                    for m in expr.finditer(text):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans[row].append((m.start(), k, m.end()))
        return [sorted(x) for x in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: the id and spans, an array of (kind, start, end) by start and then rule order.

    Code points, end exclusive. Null and empty texts have no spans. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in scanner(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds and the spans as text, with the hash of the base spans' text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE_RULES]))
    of_kind = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [of_kind(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select(id_col, *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = WHOLE_RULES, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, each secret in the text replaced by the mark; overlapping spans become one mark."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = batch.column(k).to_pylist()
            for row, spans in enumerate(scanner(batch.column(k))):
                if spans:
                    out, at = [], 0
                    for start, _, end in spans:
                        if start >= at:
                            out += [texts[row][at:start], mark]
                        at = max(at, end)
                    texts[row] = "".join(out) + texts[row][at:]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def sha256_of(spans: list[str]) -> str:
    """The digest of span texts, for checks outside Spark."""
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
