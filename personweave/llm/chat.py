"""Chat formatting: typed content parts, flattened by a visitor into one templated string.

A message holds parts of type text, image, audio or document. The visitor writes text parts escaped
and all others as ordered placeholders, and records for each its reference and the number of tokens
that it expands to. Texts that spell a placeholder are escaped like all control strings, so both are told apart. The template is <|turn|>role, newline, content, <|end|>, newline. Inside roles and
contents a backslash is doubled and a control string gets one after its first character, so control
strings stand only where the template put them, and unescaping restores every text exactly.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import importable

TURN, END = "<|turn|>", "<|end|>"
KINDS = ("text", "image", "audio", "document")
#: Besides the template's own, strings that other chat templates take for control.
CONTROL = re.compile(r"<\|[a-z_]+\|>|</?s>|\[/?INST\]|<</?SYS>>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document|unknown)\|>")
_HALF = re.compile("[\ud800-\udfff]")
#: The largest size of a part that counts.
MOST = 10**9
_ROLE_END = re.compile(r"(?:\\.|[^\\\n])*", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


@dataclass
class Costs:
    """Tokens that placeholders expand to."""

    patch: int = 28
    tokens_a_second: float = 25.0
    tokens_a_page: int = 1024


def _valid(text: str) -> str:
    """Halves of surrogate pairs, which JSON can spell and UTF-8 cannot, become U+FFFD."""
    return _HALF.sub("\ufffd", text)


def _size(part: dict, key: str) -> float:
    """A part's number; 0 for what is not a number from 0 to MOST."""
    try:
        found = float(part.get(key) or 0)
    except (TypeError, ValueError, OverflowError):
        return 0.0
    return found if 0 <= found <= MOST else 0.0


class Visitor:
    """Writes the parts of one message after another.

    `attachments` has (kind, reference, tokens) of each placeholder of all messages, in order. Texts that
    follow each other are escaped as one, so no control string forms across parts.
    """

    def __init__(self, costs: Costs | None = None) -> None:
        self.costs = costs or Costs()
        self.attachments: list[tuple[str, str, int]] = []
        self.pending: list[str] = []
        self.out: list[tuple[bool, str]] = []

    def message(self, parts: list[dict]) -> list[tuple[bool, str]]:
        """(whether it is text, what is written) of each run of text parts and each placeholder."""
        self.out = []
        for part in parts:
            self.visit(part)
        self._flush()
        return self.out

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}" if kind in KINDS else "visit_unknown")(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        self.pending.append(text if isinstance(text, str) else "" if text is None else json.dumps(text))

    def visit_image(self, part: dict) -> None:
        side = lambda k: math.ceil(_size(part, k) / self.costs.patch)
        self._placeholder("image", part, max(1, side("width") * side("height")))

    def visit_audio(self, part: dict) -> None:
        self._placeholder("audio", part, max(1, round(_size(part, "seconds") * self.costs.tokens_a_second)))

    def visit_document(self, part: dict) -> None:
        self._placeholder("document", part, max(1, int(_size(part, "pages"))) * self.costs.tokens_a_page)

    def visit_unknown(self, part: dict) -> None:
        self._placeholder("unknown", part, 0)

    def _flush(self) -> None:
        if self.pending:
            self.out.append((True, escape(_valid("".join(self.pending)))))
            self.pending = []

    def _placeholder(self, kind: str, part: dict, tokens: int) -> None:
        self._flush()
        ref = part.get("ref")
        self.attachments.append((kind, "" if ref is None else _valid(str(ref)), tokens))
        self.out.append((False, f"<|{kind}|>"))


def parts_of(content: str | None, typed: bool) -> list[dict]:
    """The parts of a message: its text alone, or, if typed, a JSON array of parts (else text)."""
    if typed and content:
        try:
            found = json.loads(content)
        except (ValueError, RecursionError):
            found = None
        if isinstance(found, list):
            return [p if isinstance(p, dict) else {"type": "text", "text": str(p)} for p in found]
    return [{"type": "text", "text": content or ""}]


def illustrated(content: str | None) -> list[dict]:
    """A text as typed parts: its lines, each with its newline, and after each newline a part about the line before.

    In turn these are an image as wide as the line has characters and 56 high, an audio of as many seconds,
    and a document with a page for each hundred. The texts of the parts, joined, are the text.
    """
    lines = (content or "").split("\n")
    parts: list[dict] = []
    for k, line in enumerate(lines[:-1]):
        n, ref = len(line), f"line-{k}"
        about = ({"type": "image", "width": n, "height": 56}, {"type": "audio", "seconds": n}, {"type": "document", "pages": n // 100})[k % 3]
        parts += [{"type": "text", "text": line + "\n"}, {**about, "ref": ref}]
    return [*parts, {"type": "text", "text": lines[-1]}]


def format_turns(turns: list[tuple[str | None, str | None]], typed: bool = False, costs: Costs | None = None, parts: Callable[[str | None], list[dict]] | None = None) -> tuple[str, list[tuple[int, int]], list[tuple[str, str, int]]]:
    """(formatted, loss spans, attachments) of (role, content) turns; the spans hold assistants' texts, without placeholders."""
    visitor, out, spans, at = Visitor(costs), [], [], 0
    for role, content in turns:
        head = f"{TURN}{escape_role(role or '')}\n"
        out.append(head)
        at += len(head)
        for is_text, written in visitor.message(parts(content) if parts else parts_of(content, typed)):
            if is_text and role == "assistant":
                spans.append((at, at + len(written)))
            out.append(written)
            at += len(written)
        out += [END, "\n"]
        at += len(END) + 1
    return "".join(out), spans, visitor.attachments


def read_parts(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of each turn: ("text", text) of each run of text, unescaped, and (kind, "") of each placeholder.

    A placeholder that a text spells is escaped there, so it is read as text.
    """
    at = 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        role = _ROLE_END.match(formatted, at + len(TURN))
        body = role.end() + 1
        end = formatted.index(END + "\n", body)
        parts, start = [], body
        for m in _PLACEHOLDER.finditer(formatted, body, end):
            if m.start() > start:
                parts.append(("text", unescape(formatted[start : m.start()])))
            parts.append((m[1], ""))
            start = m.end()
        if end > start:
            parts.append(("text", unescape(formatted[start:end])))
        yield unescape(role[0]), parts
        at = end + len(END) + 1


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted string, unescaped; placeholders are no text."""
    for role, parts in read_parts(formatted):
        yield role, "".join(text for kind, text in parts if kind == "text")


def format_conversations(messages: DataFrame, typed: bool = False, costs: Costs | None = None, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), parts: Callable[[str | None], list[dict]] | None = None) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, attachments): one row for each conversation.

    A text is one text part; if typed, a JSON array of parts; or what `parts` makes of it. In a part, a
    text that is no string counts as its JSON, a size that is no number from 0 to 10^9 as 0, a kind
    that is not known as a placeholder without tokens; halves of surrogate pairs become U+FFFD.
    Turns stand in order of their number, ties by role, then text, nulls first; repeated rows are
    turns of their own. Null roles and texts are empty. Rows of null conversation are one
    conversation. An empty table gives an empty one. Other columns are not read. Rows are sorted
    inside partitions and read as a stream, so a task holds one conversation at a time, and of it
    only its formatted string, which is one cell of the result.
    """
    importable(messages.sparkSession)
    conv, turn, role, text = columns
    kept = messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
    spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "formatted", "loss_spans", "attachments"]
        types = [pa.int64(), pa.int64(), pa.string(), spans_kind, kind]

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def finish(key: int | None, turns: list) -> tuple:
            formatted, spans, attachments = format_turns(turns, typed, costs, parts)
            return key, len(turns), formatted, [{"start": a, "end": b} for a, b in spans], [{"kind": k, "ref": r, "tokens": n} for k, r, n in attachments]

        key, turns, done, held = None, [], [], 0
        for batch in batches:
            for c, r, t in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if turns and c != key:
                    done.append(finish(key, turns))
                    held, turns = held + len(done[-1][2]), []
                    if held > 4 << 20:
                        yield emit(done)
                        done, held = [], 0
                key = c
                turns.append((r, t))
        if turns:
            done.append(finish(key, turns))
        if done:
            yield emit(done)

    schema = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>, attachments array<struct<kind:string,ref:string,tokens:long>>"
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, expanded_tokens).

    Reads the result of format_conversations again: its turns' texts and the number of placeholders from the
    formatted string, its trained text from the loss spans, the tokens from the attachments.
    """
    importable(formatted.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def one(text: str, spans: list[dict], attachments: list[dict]) -> tuple:
        turns, n, placed = hashlib.sha256(), 0, 0
        for role, parts in read_parts(text):
            own = "".join(t for kind, t in parts if kind == "text")
            turns.update(f"{role}\n{own}\n".encode())
            n += 1
            placed += sum(kind != "text" for kind, _ in parts)
        loss, chars = hashlib.sha256(), 0
        for span in spans:
            trained = unescape(text[span["start"] : span["end"]])
            loss.update(trained.encode())
            chars += len(trained)
        return n, turns.hexdigest(), chars, loss.hexdigest(), len(text), placed, sum(a["tokens"] for a in attachments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, *one(*x)) for c, *x in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_spans", "attachments")), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")


ORACLE_SQL = r"""
WITH m AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(turn, -9e18) AS k, string_split(coalesce(text, ''), chr(10)) AS x FROM m),
e AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<)(\|[a-z_]+\|>|/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')) AS n_text,
             length(regexp_replace(replace(role, '\', '\\'), '(<)(\|[a-z_]+\|>|/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g'))
               + length(role) - length(replace(role, chr(10), '')) AS n_role,
             len(x) - 1 AS n_parts, (len(x) - 1) // 3 AS n_documents,
             coalesce(list_sum(list_transform(range(1, len(x)), lambda i: CASE (i - 1) % 3 WHEN 0 THEN greatest(1, 2 * ((length(x[i]) + 27) // 28)) WHEN 1 THEN greatest(1, 25 * length(x[i])) ELSE 1024 * greatest(1, length(x[i]) // 100) END)), 0) AS n_tokens FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n_text + n_role + 17 + 9 * n_parts + 3 * n_documents)::BIGINT AS formatted_chars, sum(n_parts)::BIGINT AS n_attachments, sum(n_tokens)::BIGINT AS expanded_tokens
FROM e GROUP BY conv_id
"""
