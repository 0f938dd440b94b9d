"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import byte_batches, table
from larkspur.llm.tokenizing import encode_ids, hf_tokenizer, public_path, sentencepiece_model

#: Texts above this many bytes are split at safe boundaries.
LONG_TEXT = 50_000
#: Encoded text per batch.
BATCH_BYTES = 1 << 20

#: letter, one space, letter: neither the normaliser nor a merge reaches across such a space.
BOUNDARY = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Ideographs, kana and syllables: characters that normalising leaves as they are, whatever of them stands beside.
STABLE = re.compile(r"(?<=[\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3])(?=[\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3])")
#: Goes before a part that doesn't begin with a word, in place of the space mark that a model puts there.
LEAD = "a"


@functools.lru_cache(maxsize=4)
def splits_safely(path: str) -> str:
    """How texts of this tokenizer may be split at BOUNDARY.

    "drop": the next part goes without its space, as the model puts a space mark before each text.
    "keep": the next part starts with the space, as the pre-tokenizer always cuts before it.
    "": not at all.
    """
    if path.endswith(".model"):
        sp = sentencepiece_model(path)
        inner = any(re.search("[^▁]▁", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
        marks = sp.encode(["a b", "a"], out_type=str, num_threads=1)
        plain = sp.encode(" a", out_type=str, num_threads=1)
        return "drop" if not inner and marks[1][0].startswith("▁") and plain[0] == "▁" else ""
    cut = hf_tokenizer(path).pre_tokenizer.pre_tokenize_str("a b") if hf_tokenizer(path).pre_tokenizer else []
    return "keep" if len(cut) == 2 and cut[1][1][0] in (1, 2) else ""


class Seams:
    """Where texts without spaces may be cut: between characters that no piece of the vocabulary has in a row.

    Whatever is merged is a piece, so nothing is merged across. Both characters are pieces themselves, as unknown ones
    in a row become a single token.
    """

    def __init__(self, path: str) -> None:
        self.pairs: set[str] = set()
        self.known: set[str] = set()
        self.lead = 0
        if splits_safely(path) == "drop":
            sp = sentencepiece_model(path)
            pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
            self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
            self.known = {p for p in pieces if len(p) == 1}
            if LEAD in self.known and sp.encode(["一", LEAD + "一"], out_type=str, num_threads=1) == [["▁", "一"], ["▁" + LEAD, "一"]]:
                self.lead = len(sp.encode(LEAD, num_threads=1))

    def find(self, text: str, start: int, end: int) -> int | None:
        """The first place from start on, and before end, at which a part may begin."""
        if self.lead:
            for m in STABLE.finditer(text, start, end):
                a, b = text[m.start() - 1], text[m.start()]
                if a in self.known and b in self.known and a + b not in self.pairs and LEAD + b not in self.pairs:
                    return m.start()
        return None


@functools.lru_cache(maxsize=4)
def seams(path: str) -> Seams:
    return Seams(path)


def parts_of(text: str, how: str, limit: int = LONG_TEXT, inside: Seams | None = None) -> list[tuple[str, int]]:
    """(part, tokens that it has too many): their counts sum to the count of the text. limit is in bytes."""
    size = len(text.encode())
    step = max(1, limit * len(text) // max(1, size))  # characters that come to about limit bytes
    parts, minus = [], 0
    while how and len(text) > step:
        m = BOUNDARY.search(text, step)
        seam = inside.find(text, step, m.start() if m else len(text)) if inside else None
        if seam is not None:
            parts.append((text[:seam], minus))
            text, minus = LEAD + text[seam:], inside.lead
        elif m:
            parts.append((text[: m.start()], minus))
            text, minus = text[m.end() if how == "drop" else m.start() :], 0
        else:
            break
    return [*parts, (text, minus)]


def split_long(text: str, how: str, limit: int = LONG_TEXT) -> list[str]:
    """Parts, split at BOUNDARY alone, whose token counts sum to the count of the text."""
    return [part for part, _ in parts_of(text, how, limit)]


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    how, inside = splits_safely(path), seams(path)
    for batch in byte_batches(batches, BATCH_BYTES, 1):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        lengths = pc.binary_length(batch.column(1)).fill_null(0).cast(pa.int64())
        parts, owner, sizes = [], [], []
        counts = [0] * len(texts)
        for i, (t, n) in enumerate(zip(texts, lengths.to_pylist(), strict=True)):
            own = parts_of(t, how, LONG_TEXT, inside) if n > LONG_TEXT else [(t, 0)]
            parts += [p for p, _ in own]
            owner += [i] * len(own)
            sizes += [len(p.encode()) for p, _ in own] if len(own) > 1 else [n]
            counts[i] -= sum(minus for _, minus in own)
        order = sorted(range(len(parts)), key=sizes.__getitem__)
        start = 0
        while start < len(order):  # balanced by bytes: short texts go together, long ones alone
            end, held = start, 0
            while end < len(order) and (end == start or held + sizes[order[end]] <= BATCH_BYTES):
                held += sizes[order[end]]
                end += 1
            for i, ids in zip(order[start:end], encode_ids(path, [parts[i] for i in order[start:end]]), strict=True):
                counts[owner[i]] += len(ids)
            start = end
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), lengths, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text.

    A null text counts as empty (0, 0, false). Rows with equal ids are counted each on its own, other
    columns are ignored, and an empty table gives an empty result. `path` names a vocabulary file:
    `.json` is read by tokenizers, `.model` by sentencepiece. Texts over LONG_TEXT bytes are encoded in
    parts, cut where the tokenizer provably cuts as well: at spaces between letters, and with a `.model` between
    ideographs, kana or syllables that no piece has in a row. Without such a place they stay whole.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        lambda batches: _count(batches, path, limit),
        f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean",
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))
