"""Benchmark decontamination: every test suffix is looked up in suffix arrays of the training text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, bounded_broadcast, table, text_batches, unused
from larkspur.llm.tokenizing import tidy

WINDOW = 10
#: Training text in one suffix array.
SHARD_BYTES = 2 << 20
#: Benchmark text searched in one pass over the documents. A larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20
#: Leaking rows whose ids may be broadcast; beyond it, a shuffle join does the same.
BROADCAST_ROWS = 1_000_000

#: ASCII bytes that aren't letters or digits part words; A-Z become a-z.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Suffixes:
    """The test side: all items' words in one row of ids, and the windows that count as a leak."""

    vocabulary: dict[bytes, int]
    tokens: np.ndarray  # item after item, 0 after each
    item_ids: list
    window_at: np.ndarray  # place of each window's first word in tokens
    window_n: np.ndarray  # words in it
    window_item: np.ndarray
    item_end: np.ndarray  # for each window, the place after its item's last word

    @property
    def depth(self) -> int:
        return int(self.window_n.max())


def test_suffixes(items: list[tuple[object, bytes | None]], window: int) -> Suffixes | None:
    """A window per suffix of at least `window` words; an item of fewer words is one window. None without any."""
    vocabulary: dict[bytes, int] = {}
    tokens: list[int] = []
    at, n, item, end = [], [], [], []
    for k, (_, text) in enumerate(items):
        own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        if own:
            starts = range(max(1, len(own) - window + 1))
            at += [len(tokens) + s for s in starts]
            n += [min(window, len(own))] * len(starts)
            item += [k] * len(starts)
            end += [len(tokens) + len(own)] * len(starts)
        tokens += [*own, 0]
    if not at:
        return None
    return Suffixes(
        vocabulary, np.array(tokens, np.int64), [i for i, _ in items], *(np.array(x, np.int64) for x in (at, n, item, end))
    )


def suffix_array(tokens: np.ndarray, test: Suffixes) -> np.ndarray:
    """Places of the training suffixes in the order of their first `depth` words.

    Places from which no test suffix can be matched - the first word isn't in the benchmark, or the first
    two aren't next to each other in it, where every window has two words - are left out beforehand.
    """
    known = np.flatnonzero(tokens[: len(tokens) - test.depth])
    if test.window_n.min() > 1:
        size = len(test.vocabulary) + 1
        pairs = np.unique(test.tokens[:-1] * size + test.tokens[1:])
        own = tokens[known] * size + tokens[known + 1]
        slot = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
        known = known[pairs[slot] == own]
    bits = max(1, len(test.vocabulary)).bit_length()
    per_key = max(1, 62 // bits)
    keys = []
    for first in range(0, test.depth, per_key):
        key = np.zeros(len(known), np.int64)
        for k in range(first, min(test.depth, first + per_key)):
            key = (key << bits) | tokens[known + k]
        keys.append(key)
    return known[np.lexsort(keys[::-1])]


def _bounds(tokens: np.ndarray, order: np.ndarray, test: Suffixes, after: bool) -> np.ndarray:
    """By binary search for all windows at once: the first place in `order` not before (or after) the window."""
    low = np.zeros(len(test.window_at), np.int64)
    high = np.full(len(test.window_at), len(order), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        place = order[np.minimum(mid, len(order) - 1)]
        sign = np.zeros(len(mid), np.int64)
        for k in range(test.depth):
            inside = (sign == 0) & (k < test.window_n)
            if not inside.any():
                break
            have, want = tokens[place[inside] + k], test.tokens[test.window_at[inside] + k]
            sign[inside] = np.sign(have - want)
        right = open_ & ((sign < 0) | (after & (sign == 0)))
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low


def occurrences(tokens: np.ndarray, test: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, place, words matched from there on, up to the item's end) of every verbatim occurrence."""
    order = suffix_array(tokens, test)
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    low, high = _bounds(tokens, order, test, False), _bounds(tokens, order, test, True)
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    place = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
    length = test.window_n[window].copy()
    growing = np.arange(len(window))
    while len(growing):
        at = test.window_at[window[growing]] + length[growing]
        more = (at < test.item_end[window[growing]]) & (place[growing] + length[growing] < len(tokens))
        growing, at = growing[more], at[more]
        same = tokens[place[growing] + length[growing]] == test.tokens[at]
        growing = growing[same]
        length[growing] += 1
    return window, place, length


@tidy
def _search(batches: Iterator[pa.RecordBatch], test: Suffixes | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        start = 0
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and held < SHARD_BYTES:
                held += len(texts[end] or b"")
                end += 1
            found = _shard([words(t) for t in texts[start:end]], test)
            rows = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *found], names=[*FOUND_NAMES])
            start = end


FOUND_NAMES = ("doc_id", "text", "n_words", "hits", "items", "matches")
_MATCH = pa.struct([("item_id", pa.string()), ("at", pa.int64()), ("words", pa.int64())])


def _shard(docs: list[list[bytes]], test: Suffixes | None) -> list[pa.Array]:
    """n_words, hits, items and matches of the documents of one suffix array."""
    n_words = np.array([len(d) for d in docs], np.int64)
    hits: list = [[] for _ in docs]
    items: list[list[str]] = [[] for _ in docs]
    matches: list[list[dict]] = [[] for _ in docs]
    if test is not None:
        get = test.vocabulary.get
        first = np.cumsum(n_words + 1) - n_words - 1
        tokens = np.zeros(int((n_words + 1).sum()) + test.depth, np.int64)
        for at, d in zip(first.tolist(), docs, strict=True):
            tokens[at : at + len(d)] = [get(w, 0) for w in d]
        window, place, length = occurrences(tokens, test)
        doc = np.searchsorted(first, place, side="right") - 1
        order = np.argsort(doc, kind="stable")
        window, place, length, doc = window[order], place[order], length[order], doc[order]
        hit, starts = np.unique(doc, return_index=True)
        bounds = [*starts.tolist(), len(doc)]
        for d, a, b in zip(hit.tolist(), bounds[:-1], bounds[1:], strict=True):
            w, p, n = window[a:b], place[a:b] - first[d], length[a:b]
            cover = np.zeros(n_words[d] + 1, np.int64)
            np.add.at(cover, p, 1)
            np.add.at(cover, p + test.window_n[w], -1)
            hits[d] = np.flatnonzero(np.cumsum(cover)[:-1]).tolist()
            best = np.lexsort((p, -n, test.window_item[w]))  # of each item the longest match, then the first
            item, at = np.unique(test.window_item[w][best], return_index=True)
            for i, k in zip(item.tolist(), best[at].tolist(), strict=True):
                items[d].append(test.item_ids[i])
                matches[d].append({"item_id": test.item_ids[i], "at": int(p[k]), "words": int(n[k])})
    return [
        pa.array(n_words),
        pa.array(hits, pa.list_(pa.int32())),
        pa.array(items, pa.list_(pa.string())),
        pa.array(matches, pa.list_(_MATCH)),
    ]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes | None]]]:
    """The items in blocks of bounded size, read one after the other; one empty block if there is none."""
    block: list[tuple[str, bytes | None]] = []
    held, some = 0, False
    chosen = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("binary"))
    for item, raw in chosen.toLocalIterator():
        text = bytes(raw) if raw is not None else None
        if block and held + len(text or b"") > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += len(text or b"")
        some = True
    if block or not some:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_words, hits, items, matches) of each row of docs.

    hits: places of the words inside an occurrence of a window, ascending; items: the items with such
    windows, as distinct strings in order; matches: for each of them its longest verbatim match (item_id,
    first word's place, words). A window is `window` consecutive words of an item, or all words of an item
    that has fewer. Null and empty texts have no words and no hits; items without words are never found,
    and an item without an id is called "null". Rows with equal ids are searched each on its own, equal
    items are all found, further columns are ignored, an empty table gives an empty result.

    Benchmark text is broadcast in blocks of BLOCK_BYTES; each further block is one more pass over what
    the passes before it have found, kept as a table.
    """
    spark = docs.sparkSession
    text_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, text string, n_words long, hits array<int>, items array<string>, "
        "matches array<struct<item_id: string, at: long, words: long>>"
    )
    found = None
    scratch = Scratch(spark, "leaks")
    for k, block in enumerate(_blocks(benchmark)):
        test = spark.sparkContext.broadcast(test_suffixes(block, window))
        if found is None:
            found = docs.select("doc_id", "text").mapInArrow(lambda b, t=test: _search(b, t.value), schema)
        else:
            before = scratch.keep(found, f"pass-{k}")
            found = before.mapInArrow(lambda b, t=test: _search_again(b, t.value), schema)
    return found.withColumn("hits", F.array_sort(F.array_distinct("hits"))).withColumn(
        "items", F.array_sort(F.array_distinct("items"))
    )


def _search_again(batches: Iterator[pa.RecordBatch], test: Suffixes | None) -> Iterator[pa.RecordBatch]:
    """Adds what a further block finds to earlier findings."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches(_search(iter([batch]), test)).combine_chunks().to_batches()[0]
        joined = [
            pa.array([a + b for a, b in zip(batch.column(n).to_pylist(), new.column(n).to_pylist(), strict=True)], new.column(n).type)
            for n in ("hits", "items", "matches")
        ]
        yield pa.RecordBatch.from_arrays([new.column(0), new.column(1), new.column(2), *joined], names=[*FOUND_NAMES])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a window of the benchmark; the rest keeps its columns and rows.

    Rows are told apart by (doc_id, text), so of two rows with one id only the one that leaks goes.
    """
    bad = leaks(docs, benchmark, window).where(F.size("hits") > 0)
    bad_id, bad_text = unused(docs, "bad_id"), unused(docs, "bad_text")
    bad = bad.select(F.col("doc_id").alias(bad_id), F.xxhash64("text").alias(bad_text)).distinct()
    bad = bounded_broadcast(Scratch(docs.sparkSession, "leaked").keep(bad, "rows"), BROADCAST_ROWS)
    same = docs["doc_id"].eqNullSafe(bad[bad_id]) & (F.xxhash64(docs["text"]) == bad[bad_text])
    return docs.join(bad, same, "left_anti")


def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
