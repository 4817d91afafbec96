"""Secret scans with multipart credential linking.

Base patterns give spans of their own. Besides, two weak kinds are candidates: bare keys (40 and
more letters of base 64 with a digit, upper and lower case) and endpoints (host names behind a scheme or of a
cloud service). A scope is the text within SCOPE characters of an access identifier, cut at
blank lines. Candidates are found in the whole text and joined to scopes by a sweep over sorted intervals:
one that lies in a scope with any of its letters belongs to it as a whole. They are reported only
where complementary parts meet: a key beside an access identifier, an endpoint beside an access identifier
and a key or another base secret. Only access identifiers anchor a scope.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import map_rows, map_texts, slices

#: Kinds of the base patterns, in the order of their listing, then those that linking adds.
KINDS = ("assign", "access", "hex", "linked_key", "linked_endpoint")
SCOPE = 400

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_KEY = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
_ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:amazonaws|digitaloceanspaces|backblazeb2|wasabisys)\.com(?![A-Za-z0-9-])")
_BLANK = re.compile(r"\n[ \t]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind; what is too short is dropped."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a match of the plain pattern is a whole run of such letters, so long runs are its long matches
    return out + [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]


def joined(spans: list[tuple[int, int]], scopes: list[list[int]]) -> list[range]:
    """For each scope the places of the spans that overlap it; both lists are sorted and free of overlaps."""
    out, at = [], 0
    for low, high in scopes:
        while at < len(spans) and spans[at][1] <= low:
            at += 1
        to = at
        while to < len(spans) and spans[to][0] < high:
            to += 1
        out.append(range(at, to))
        at = max(at, to - 1)
    return out


def linked_spans(text: str, base: Iterable[Span]) -> list[Span]:
    """Weak candidates that meet their complementary parts within a scope."""
    anchors = sorted((a, b) for kind, a, b in base if kind == "access")
    if not anchors:
        return []
    edges = [m.start() for m in _BLANK.finditer(text)]
    scopes: list[list[int]] = []
    for a, b in anchors:
        k = bisect_left(edges, a)
        low = max(a - SCOPE, edges[k - 1] if k else 0)
        high = min(b + SCOPE, edges[k] if k < len(edges) else len(text))
        if scopes and low < scopes[-1][1]:
            scopes[-1][1] = max(scopes[-1][1], high)
        else:
            scopes.append([low, high])
    taken = sorted((a, b) for kind, a, b in base if kind != "assign")
    keys = []
    for m in _KEY.finditer(text):
        s = m[0]
        # a key is a whole run of letters that access and hex spans consist of, so one that it meets starts inside
        k = bisect_left(taken, (m.start(), 0))
        overlaps = k < len(taken) and taken[k][0] < m.end()
        if not overlaps and re.search("[0-9]", s) and re.search("[A-Z]", s) and re.search("[a-z]", s):
            keys.append(m.span())
    near = joined(keys, scopes)
    out: set[Span] = {("linked_key", *keys[i]) for found in near for i in found}
    strong = [joined([(a, b) for kind, a, b in base if kind == one], scopes) for one in ("assign", "hex")]
    paired = [scope for scope, *found in zip(scopes, near, *strong, strict=True) if any(found)]
    if paired:
        ends = [m.span() for m in _ENDPOINT.finditer(text)]
        out |= {("linked_endpoint", *ends[i]) for found in joined(ends, paired) for i in found}
    return sorted(out, key=lambda s: s[1:])


def find(text: str | None) -> list[Span]:
    """All spans (kind, start, end) by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    base = base_spans(text)
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted([*base, *linked_spans(text, base)], key=lambda s: (s[1], rank[s[0]], s[2]))


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by the mark."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    low, high = spans[0][1:]
    for _, a, b in spans[1:]:
        if a < high:
            high = max(high, b)
        else:
            out += [text[at:low], mark]
            at, low, high = high, a, b
    return "".join([*out, text[at:low], mark, text[high:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): one row for each document.

    spans lists all of them as kind:start:end, joined by commas; base_sha256 is the digest of the base
    ones so listed. Null and empty text: no spans. Repeated rows and null ids stay. An empty table
    gives an empty one. Other columns are not read.
    """

    def make() -> Callable:
        def work(ids: list, texts: list) -> list:
            out: list[list] = [ids, [], [], [], [], []]
            for text in texts:
                spans = find(text)
                base = [s for s in spans if s[0] in KINDS[:3]]
                for column, kind in zip(out[1:4], KINDS, strict=False):
                    column.append(sum(s[0] == kind for s in base))
                out[4].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out[5].append(listed(spans))
            return out

        return work

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    return map_texts(docs, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", names, [pa.int64()] * 4 + [pa.string()] * 2, id_col, text_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents, every span in their text replaced by the mark; all rows and columns stay.

    Null text stays null. Rows that repeat are redacted alike, and an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = pa.array([redact(t, mark) for t in part.column(at).to_pylist()], part.column(at).type)
                yield part.set_column(at, part.schema.field(at), texts)

    return map_rows(docs, run)


def _either_case(word: str) -> str:
    """DuckDB's own folding of case knows more letters than A-Z."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The numbers of base spans of each kind.
COUNTS_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(x, '({"|".join(map(_either_case, ("password", "passwd", "secret", "token")))}|{_either_case("api")}_?{_either_case("key")})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda m: length(m) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(x, 'AKIA[A-Z0-9]+'), lambda m: length(m) >= 20))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(x, '[0-9a-f]+'), lambda m: length(m) >= 24))::BIGINT AS n_hex
FROM t
"""
