"""Chat formatting with spans found by incremental rendering of a template that is a black box.

A template is any function from turns to text. Prefixes of the conversation are rendered one turn longer
each time; where an output starts with the one before, the rest is the span of the new turn, and where it
does not, the template rewrites history and is reported so. Within a span, the text of the turn is
located by rendering the same turn with two probe texts: what their spans share before and
after is the template's. Only the text of assistant turns is under the loss mask.

For any function the prefixes are those of the whole conversation, whatever its length: one conversation is in memory,
and the work grows with the square of its turns. A template may say that what it writes for a turn depends on so many turns
before it at most (``Local``): then prefixes begin that many turns back and a conversation streams through. The
statement is tested at every turn by a prefix that begins one turn earlier. The default template is such a one.

The default template marks turns with control strings and escapes such strings inside texts reversibly, so
turns can be read back from the output alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_parts, table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
OPEN, SEP, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
ESCAPE = "\\"
PROBES = ("A", "B")


def escape(text: str) -> str:
    """Keep ``<|`` out of a text: a backslash comes before its bar and before every backslash."""
    return text.replace(ESCAPE, ESCAPE * 2).replace("<|", "<" + ESCAPE + "|")


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    out, at = [], 0
    while (k := text.find(ESCAPE, at)) >= 0:
        out.append(text[at:k])
        out.append(text[k + 1 : k + 2])
        at = k + 2
    return "".join(out) + text[at:]


@dataclass(frozen=True)
class Local:
    """A template that writes a turn by that turn and at most ``memory`` turns before it, whatever else came earlier."""

    template: Template
    memory: int = 0

    def __call__(self, turns: list[Turn]) -> str:
        return self.template(turns)


def concatenate(turns: list[Turn]) -> str:
    return "".join(f"{OPEN}{escape(role)}{SEP}{escape(text)}{CLOSE}\n" for role, text in turns)


#: The default template: no turn's output depends on its neighbours.
render = Local(concatenate)


def read_back(formatted: str) -> list[Turn]:
    """The turns of an output of ``render``."""
    out, at = [], 0
    while at < len(formatted):
        head = formatted.index(OPEN, at) + len(OPEN)
        sep = formatted.index(SEP, head)
        end = formatted.index(CLOSE, sep)
        out.append((unescape(formatted[head:sep]), unescape(formatted[sep + len(SEP) : end])))
        at = end + len(CLOSE) + 1
    return out


class RewritesHistory(ValueError):
    """A longer conversation does not start with the rendering of its beginning."""


@dataclass(frozen=True)
class Span:
    """Where a turn stands in the output, and its text within."""

    start: int
    end: int
    text_start: int
    text_end: int


def _common(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _span(template: Template, head: list[Turn], before: str, turn: Turn) -> tuple[str, int, int]:
    """The text that ``turn`` adds to ``before = template(head)``, and where its own text begins and ends there."""
    role, _ = turn
    now = template([*head, turn])
    if not now.startswith(before):
        raise RewritesHistory("a turn changes what stands before it")
    one, two = (template([*head, (role, p)])[len(before) :] for p in PROBES)
    lead = _common(one, two)
    tail = len(one) - lead - len(PROBES[0])
    span = now[len(before) :]
    if len(one) != len(two) or span[:lead] != one[:lead] or span[len(span) - tail :] != one[len(one) - tail :]:
        raise RewritesHistory("a turn is not rendered alike for all texts")
    return span, lead, len(span) - tail


def locate(template: Template, turns: list[Turn]) -> tuple[str, list[Span]]:
    """Render successive prefixes and compare neighbours: the whole output and the span of each turn.

    Raises RewritesHistory if an output does not extend the one before, or if the probes' spans
    differ in more than the text (a template that changes texts other than by escaping them).
    """
    spans: list[Span] = []
    before = template([])
    for i, turn in enumerate(turns):
        span, first, last = _span(template, turns[:i], before, turn)
        at = len(before)
        spans.append(Span(at, at + len(span), at + first, at + last))
        before += span
    return before, spans


@dataclass
class _State:
    """What is known of the conversation at hand; hashes grow turn by turn."""

    conv_id: int | None
    n: int = 0
    chars: int = 0
    loss_chars: int = 0
    rewrites: bool = False

    def __post_init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.window: list[Turn] = []

    def read(self, turns: Iterable[Turn], said: Iterable[str | None]) -> None:
        """Turns read back from the output, each with its text under the loss mask."""
        for (role, text), own in zip(turns, said, strict=True):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if own is not None and role == "assistant":
                self.loss.update(own.encode())
                self.loss_chars += len(own)


def _stream(state: _State, template: Local, turn: Turn, unrender, unmask) -> None:
    """Render one more turn after the last ones, and take what is told from its span."""
    if not state.n:
        state.chars = len(template([]))
    head = state.window
    before = template(head)
    try:
        span, first, last = _span(template, head, before, turn)
        if len(head) > template.memory:  # the same turn after one turn less
            near = head[1:]
            if template([*near, turn])[len(template(near)) :] != span:
                raise ValueError(f"the template remembers more than the {template.memory} turns that it states")
        said = unmask(span[first:last])
    except RewritesHistory:
        state.rewrites, span, said = True, template([*head, turn])[len(before) :], None
    state.chars += len(span)
    state.read(unrender(span), [said])
    state.window = [*head, turn][-(template.memory + 1) :]


def _whole(state: _State, template: Template, unrender, unmask) -> None:
    """Render the conversation by all its prefixes, and take everything told from its output."""
    turns = state.window
    try:
        out, spans = locate(template, turns)
        said = [unmask(out[x.text_start : x.text_end]) for x in spans]
    except RewritesHistory:
        state.rewrites, out, said = True, template(turns), [None] * len(turns)
    state.chars = len(out)
    state.read(unrender(out), said)


def formatted(rows: Iterable[tuple], template: Template = render, unrender=read_back, unmask=unescape) -> Iterator[_State]:
    """Rows (conv_id, role, text) in order of turns, conversations together: one state per conversation.

    ``unrender`` reads turns from an output; of a ``Local`` template it is given the span of one turn.
    """

    def done(state: _State) -> _State:
        if not isinstance(template, Local):
            _whole(state, template, unrender, unmask)
        if state.rewrites:
            state.loss, state.loss_chars = hashlib.sha256(), 0
        return state

    state = None
    for conv_id, role, text in rows:
        if state is None or conv_id != state.conv_id:
            if state is not None:
                yield done(state)
            state = _State(conv_id)
        turn = (role or "", text or "")
        if isinstance(template, Local):
            _stream(state, template, turn, unrender, unmask)
        else:
            state.window.append(turn)
    if state is not None:
        yield done(state)


_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"


def format_conversations(conversations: DataFrame, template: Template = render, unrender=read_back, unmask=unescape) -> DataFrame:
    """One row of _SCHEMA per conversation, read back from its output.

    Turns are ordered by turn, then role and text (nulls first), so repeated rows are repeated turns; a null
    role or text counts as empty, and rows with a null conv_id are one conversation. A conversation
    of a template that rewrites history is marked and has no loss. An empty table gives no row.
    Other columns are not read. Conversations are streamed from sorted partitions, with a ``Local`` template turn by turn.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    wanted = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    dealt = wanted.repartition(shuffle_parts(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))))
        out = []

        def batch():
            cols = zip(*((s.conv_id, s.n, s.turns.hexdigest(), s.loss_chars, s.loss.hexdigest(), s.chars, s.rewrites) for s in out))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _SCHEMA.split(", ")])

        for state in formatted(rows, template, unrender, unmask):
            out.append(state)
            if len(out) == 5_000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return dealt.mapInArrow(run, _SCHEMA)


def texts(conversations: DataFrame, template: Template = render) -> DataFrame:
    """(conv_id, formatted, spans): the outputs themselves, for conversations that fit in memory one by one."""
    schema = "conv_id long, formatted string, spans array<struct<start:int,end:int,text_start:int,text_end:int>>"

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["turn", "role", "text"], na_position="first")
        turns = [(r or "", t or "") for r, t in zip(pdf["role"], pdf["text"])]
        out, spans = locate(template, turns)
        return pd.DataFrame([[key[0], out, [vars(s) for s in spans]]], columns=["conv_id", "formatted", "spans"])

    return conversations.groupBy("conv_id").applyInPandas(run, schema)


def op6_chat(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return format_conversations(own.unionByName(planted))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + 3 * length(role) - length(replace(role, '\', '')) - length(replace(role, '<|', '.'))
            + 3 * length(text) - length(replace(text, '\', '')) - length(replace(text, '<|', '.'))) AS BIGINT) AS formatted_chars,
       false AS rewrites_history
FROM c GROUP BY conv_id
"""
