"""Chat formatting: whole conversations rendered once, encoded once with offsets, and masked by spans."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from larkspur.llm.common import shuffle_partitions, table
from larkspur.llm.tokenizing import public_path

LOSS_ROLES = ("assistant",)
#: Rendered text encoded at once.
BATCH_CHARS = 1 << 20


@dataclass(frozen=True)
class Template:
    """`<s>role[INST]text[/INST]` for each turn, then `</s>`.

    The four marks and the other strings in `reserved` never occur in an escaped text: each gets one more
    backslash after its first character, and so does each that has some there already. Taking one away
    from each gives the text back.
    """

    turn: str = "<s>"
    body: str = "[INST]"
    close: str = "[/INST]"
    end: str = "</s>"
    reserved: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "<unk>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.turn, self.body, self.close, self.end)

    @functools.cached_property
    def _guarded(self) -> re.Pattern[str]:
        words = sorted({*self.marks, *self.reserved})
        return re.compile("|".join(rf"{re.escape(w[0])}\\*{re.escape(w[1:])}" for w in words))

    def escape(self, text: str) -> str:
        return self._guarded.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._guarded.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
        """The conversation and the (start, end, role) of each turn's text in it, in code points."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, own = self.turn + self.escape(role) + self.body, self.escape(text)
            spans.append((at + len(head), at + len(head) + len(own), role))
            parts += [head, own, self.close]
            at += len(head) + len(own) + len(self.close)
        return "".join([*parts, self.end]), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns that were rendered."""
        marks = re.compile("|".join(map(re.escape, self.marks)))
        turns, last, role = [], 0, ""
        for m in marks.finditer(formatted):
            if m[0] == self.body:
                role = self.unescape(formatted[last : m.start()])
            elif m[0] == self.close:
                turns.append((role, self.unescape(formatted[last : m.start()])))
            last = m.end()
        return turns


TEMPLATE = Template()


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str, template: Template):
    """The tokenizer of the file with the template's marks as special tokens, so no token straddles one."""
    from larkspur.llm.tokenizing import hf_tokenizer

    hf_tokenizer(path)  # sets the library's environment
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in template.marks])
    return t


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int, str]], roles: tuple[str, ...]) -> np.ndarray:
    """For each token, the part (start, end) of its text that lies in a turn of the roles; (0, 0) without.

    Spans are ascending and apart, so the first one that ends after a token's start is found by binary search.
    """
    chosen = np.array([(a, b) for a, b, role in spans if role in roles and b > a], np.int64).reshape(-1, 2)
    out = np.zeros((len(offsets), 2), np.int64)
    if not len(chosen) or not len(offsets):
        return out
    at = np.minimum(np.searchsorted(chosen[:, 1], offsets[:, 0], side="right"), len(chosen) - 1)
    low, high = np.maximum(chosen[at, 0], offsets[:, 0]), np.minimum(chosen[at, 1], offsets[:, 1])
    inside = high > low
    out[inside, 0], out[inside, 1] = low[inside], high[inside]
    return out


_SCHEMA = (
    "formatted string, ids array<int>, loss array<boolean>, loss_start array<int>, loss_end array<int>"
)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    """Runs of equal conv_id in sorted rows; a run may reach over batches."""
    held: list[tuple[str, str]] = []
    key, any_ = None, False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if any_ and conv != key:
                yield key, held
                held = []
            key, any_ = conv, True
            held.append((role or "", text or ""))
    if any_:
        yield key, held


def _format(
    batches: Iterator[pa.RecordBatch], path: str, template: Template, roles: tuple[str, ...], kind: pa.DataType
) -> Iterator[pa.RecordBatch]:
    def emit(group: list[tuple[object, str, list]]) -> pa.RecordBatch:
        encodings = _tokenizer(path, template).encode_batch([g[1] for g in group], add_special_tokens=False)
        ids, spans, ends = [], [], [0]
        for (_, _, own), e in zip(group, encodings, strict=True):
            ids += e.ids
            ends.append(len(ids))
            offsets = np.fromiter(itertools.chain.from_iterable(e.offsets), np.int64, 2 * len(e)).reshape(-1, 2)
            spans.append(loss_mask(offsets, own, roles).astype(np.int32))
        span, at = np.concatenate(spans), pa.array(ends, pa.int32())
        lists = (np.array(ids, np.int32), span[:, 1] > span[:, 0], span[:, 0], span[:, 1])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([g[0] for g in group], kind),
                pa.array([g[1] for g in group], pa.string()),
                *(pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x))) for x in lists),
            ],
            names=["conv_id", "formatted", "ids", "loss", "loss_start", "loss_end"],
        )

    group, held = [], 0
    for conv, turns in _conversations(batches):
        formatted, spans = template.render(turns)
        group.append((conv, formatted, spans))
        held += len(formatted)
        if held >= BATCH_CHARS:
            yield emit(group)
            group, held = [], 0
    if group:
        yield emit(group)


def format_chats(
    conversations: DataFrame, path: str, template: Template = TEMPLATE, loss_roles: tuple[str, ...] = LOSS_ROLES
) -> DataFrame:
    """(conv_id, formatted, ids, loss, loss_start, loss_end) of each conversation.

    Rows of a conversation are put in order of turn, ties by role and text, nulls first. A null role or
    text counts as empty; a null conv_id is a conversation. Repeated rows are repeated turns. Further
    columns are ignored; an empty table gives an empty result. `loss` says for each token whether it
    holds text of a turn of `loss_roles`, and loss_start and loss_end which code points of `formatted`
    these are (0, 0 elsewhere). Bytes of one character may be spread over tokens with the same span.

    One shuffle deals conversations out; tasks then stream over sorted rows and hold one batch at a time.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    field = rows.schema["conv_id"].dataType.simpleString()
    n = shuffle_partitions(conversations.sparkSession)
    ordered = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    return ordered.select("conv_id", "role", "text").mapInArrow(
        lambda b: _format(b, path, template, loss_roles, kind), f"conv_id {field}, {_SCHEMA}"
    )


def _digest(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
        masked, start, end = (column(n).flatten().to_numpy(zero_copy_only=False) for n in ("loss", "loss_start", "loss_end"))
        sizes = pc.list_value_length(column("loss")).to_numpy()
        at = 0
        for formatted, size in zip(column("formatted").to_pylist(), sizes.tolist(), strict=True):
            turns = template.parse(formatted)
            own = np.flatnonzero(masked[at : at + size]) + at
            at += size
            a, reach = start[own], np.maximum.accumulate(end[own])  # tokens come in order, so do their parts
            new = np.append(True, a[1:] > reach[:-1]) if len(a) else np.zeros(0, bool)
            runs = zip(a[new].tolist(), reach[np.append(new[1:], True)].tolist() if len(a) else [], strict=True)
            text = "".join(template.unescape(formatted[x:y]) for x, y in runs)
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append(
                (
                    len(turns),
                    hashlib.sha256(whole.encode()).hexdigest(),
                    len(text),
                    hashlib.sha256(text.encode()).hexdigest(),
                    len(formatted),
                )
            )
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def chat_digests(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What format_chats has written, read back: turns from the text, loss text from the masked tokens."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.drop("ids").mapInArrow(
        lambda b: _digest(b, template),
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    return chat_digests(format_chats(rows.unionByName(extra), public_path("byte_bpe_50k.json")))


ORACLE_SQL = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(text,
    '([<\[])(\\*(?:s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|unk>|\|endoftext\|>|\|im_start\|>|\|im_end\|>))',
    '\1\\\2', 'g') AS guarded FROM raw
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(guarded) + 16) + 4 AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
