"""Token counts, token files and packing against plain loops over the libraries."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from larkspur.llm import packing, token_counts, token_files, tokenizing
from larkspur.llm.common import Scratch

PIECE = public_tokenizers.path("piece_bpe_32k.model")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
LONG = "One two  three <s> four. " * 9000 + "é\n\n" * 10 + "word " * 20_000
TEXTS = ["", None, "Hello world", "Hello world", " a  b ", "́x</s>", "日本語 テキスト", LONG]


def frame(spark, texts=TEXTS):
    rows = [(i // 2, t, "extra", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int")


@pytest.mark.parametrize("path", [PIECE, BYTE, public_tokenizers.path("word_bpe_49k.json")])
def test_counts(spark, path):
    got = sorted(tuple(r) for r in token_counts.token_counts(frame(spark), path, 100).collect())
    if path.endswith(".model"):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    else:
        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    want = [(i // 2, len((t or "").encode()), count(t or ""), count(t or "") > 100) for i, t in enumerate(TEXTS)]
    assert got == sorted(want)


def test_long_texts_are_split():
    assert len(token_counts.split_long(LONG, "keep")) > 1
    assert token_counts.splits_safely(PIECE) == "drop"
    assert token_counts.splits_safely(BYTE) == "keep"


def ids_of(texts):
    t = Tokenizer.from_file(BYTE)
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_crc_join():
    a, b = b"abc" * 50, b"xy" * 333
    assert token_files.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_files(spark):
    path = Scratch(spark, "t").path("ids.orc")
    token_files.write_token_orc(frame(spark), path, BYTE, files=3)
    got = sorted((tuple(r) for r in token_files.token_index(spark, path).collect()), key=lambda r: r[1])
    order = sorted(range(len(TEXTS)), key=lambda i: (i // 2, TEXTS[i] is not None, (TEXTS[i] or "").encode()))
    want, at = [], 0
    for i, ids in zip(order, ids_of([TEXTS[i] for i in order]), strict=True):
        want.append((i // 2, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert token_files.read_token_orc(spark, path, [1]).select("row").distinct().count() == 2


def test_token_files_empty(spark):
    path = Scratch(spark, "t").path("ids.orc")
    token_files.write_token_orc(frame(spark, []), path, BYTE)
    assert token_files.token_index(spark, path).collect() == []


def check_packing(rows, texts, capacity):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    for i, ids in enumerate(ids_of(texts)):
        pieces = sorted(docs[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-len(ids) // capacity)
        for p in pieces:
            assert p["ids_crc32"] == crc(ids[p["start"] : p["start"] + p["length"]])
        assert sum(p["length"] for p in pieces) == len(ids)
    return len(sequences)


def test_packing(spark):
    texts = ["word " * (i % 90) for i in range(400)] + [None, "", LONG[:30_000]]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int")
    n = check_packing(packing.pack(docs, BYTE, 128).collect(), texts, 128)
    assert n <= -(-sum(map(len, ids_of(texts))) // 128) + 2
    assert packing.pack(docs.limit(0), BYTE).collect() == []


def test_plan_is_near_the_bound_and_whole():
    rng = np.random.default_rng(5)
    for counts in (rng.integers(0, 50, 1025), np.where(np.arange(1025) % 300 == 0, 70, 0), rng.integers(0, 2, 1025)):
        counts[0] = 0
        plan = packing.plan_patterns(counts, 1024)
        held = np.zeros(1025, np.int64)
        for n, lengths in plan:
            assert sum(lengths) <= 1024
            for x in lengths:
                held[x] += n
        assert (held == counts).all()
        bound = max(-(-int((counts * np.arange(1025)).sum()) // 1024), int(counts[513:].sum()))
        assert sum(n for n, _ in plan) <= bound * 1.06 + 1


def test_words_give_the_library_s_ids():
    texts = ["a\x1cb \x85 c", "<|endoftext|> x", "  \n\n  a\u3000b", "\U0001f600 smile", "it's 1st 'lls\u200b", "\u0c5c\xa0y"]
    got = [np.frombuffer(r, "<u4").tolist() for r in tokenizing.encode_raw(BYTE, texts)]
    assert got == tokenizing.encode_ids(BYTE, texts)


def test_words_asked_for_again_are_remembered():
    """Beyond the memo's bytes only words go that weren't asked for lately; ids stay those of the library."""
    memo = tokenizing.word_memo(BYTE)
    memo.memo.clear()
    asked, encode = [], memo.memo.encode
    memo.memo.encode = lambda word, **kw: asked.append(word) or encode(word, **kw)
    try:
        texts = [f"common {i}x{i * 7919} rare{i}" for i in range(400)]
        got = [memo.raw([t], 4000)[0] for t in texts]
    finally:
        memo.memo.encode = encode
        memo.memo.clear()
    plain = Tokenizer.from_file(BYTE)
    assert got == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert asked.count("common") == 1


def test_unknown_words_go_to_the_library_together():
    """Words behind a space are encoded as one text; ids stay those of the library, wherever white space lies."""
    texts = ["one two two's three", " lead", "tail ", "a  b", "x\n y", "u\tv w", "\u0120 \u0120x", "", " ", "t\u3000 s", "long " + "y" * 200]
    memo = tokenizing.word_memo(BYTE)
    memo.memo.clear()
    asked, encode = [], memo.memo.encode
    memo.memo.encode = lambda word, **kw: asked.append(word) or encode(word, **kw)
    try:
        got = [np.frombuffer(r, "<u4").tolist() for r in memo.raw(texts, 1 << 20)]
    finally:
        memo.memo.encode = encode
        memo.memo.clear()
    assert got == tokenizing.encode_ids(BYTE, texts)
    assert not {" two", " three", " lead", " w"} & set(asked)


def test_only_documents_of_several_rows_are_put_together(spark, tmp_path, monkeypatch):
    """A first row that isn't full is a whole document; full ones and those that follow are joined."""
    join, full = token_files._join_parts, token_files.ROW_IDS

    def watched(batches):
        for batch in batches:
            for parts in batch.column(batch.schema.get_field_index("parts")).to_pylist():
                assert len(parts) > 1 or parts[0]["n"] == full
            yield from join(iter([batch]))

    monkeypatch.setattr(token_files, "_join_parts", watched)
    counts = [1, full - 1, full, full + 1, 2 * full, 2 * full + 1]  # with the end id
    docs = spark.createDataFrame([(i, "a" + " a" * (n - 2) if n > 1 else None) for i, n in enumerate(counts)], "doc_id long, text string")
    path = str(tmp_path / "ids")
    token_files.write_token_orc(docs, path, BYTE, files=2)
    got = sorted(tuple(r) for r in token_files.token_index(spark, path).collect())
    ids = [[*(Tokenizer.from_file(BYTE).encode(r["text"] or "", add_special_tokens=False).ids), 2] for r in sorted(docs.collect())]
    assert [len(x) for x in ids] == counts
    want = [(i, sum(counts[:i]), n, zlib.crc32(np.array(ids[i], "<u4").tobytes())) for i, n in enumerate(counts)]
    assert got == want


def test_a_small_packing_leaves_nothing_in_its_worker():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some text", None])], names=["doc_id", "text"])
    want = [b.to_pylist() for b in packing._pieces(iter([batch]), BYTE, 8)]
    got = [b.to_pylist() for b in tokenizing.tidy(packing._pieces)(iter([batch]), BYTE, 8)]
    assert got == want
    assert not tokenizing.word_memo.cache_info().currsize
    assert not tokenizing.hf_tokenizer.cache_info().currsize


def test_packing_alone_remembers_as_many_words_as_the_token_files(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some text"])], names=["doc_id", "text"])
    given, encode = [], packing.encode_raw
    monkeypatch.setattr(packing, "encode_raw", lambda path, texts, memo_bytes: given.append(memo_bytes) or encode(path, texts, memo_bytes))
    assert [len(list(packing._pieces(iter([batch]), BYTE, 8))), given] == [1, [tokenizing.MEMO_BYTES]]


def test_packing_alone_encodes_as_much_at_once_as_the_token_files(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["word " * 200_000] * 3)], names=["doc_id", "text"])
    given = []
    monkeypatch.setattr(packing, "encode_raw", lambda path, texts, memo_bytes: given.append(len(texts)) or [b""] * len(texts))
    assert [len(list(packing._pieces(iter([batch]), BYTE, 8))), given] == [1, [3]]
    given.clear()
    assert [len(list(packing._pieces(iter([batch]), BYTE, 8, packing.TIDY_MEMO_BYTES, packing.TIDY_BATCH_BYTES))), given] == [3, [1, 1, 1]]
