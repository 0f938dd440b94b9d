"""Types of ids, names that clash and repeated queries."""

from __future__ import annotations

import pytest

from larkspur.llm import chat, common, decontamination, nearest, token_files
from larkspur.llm.tokenizing import public_path


def test_columns_that_clash(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a {item} b", 5, "x"), (2, "clean", 6, None)], "doc_id long, text string, bad_text int, BAD_ID string")
    got = decontamination.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(2, "clean", 6, None)]


def test_string_ids_come_back_from_orc(spark, tmp_path):
    docs = spark.createDataFrame([("b", "one two"), ("a", None), (None, "x")], "doc_id string, text string")
    token_files.write_token_orc(docs, str(tmp_path / "ids"), public_path("byte_bpe_50k.json"), files=2)
    got = sorted(token_files.token_index(spark, str(tmp_path / "ids")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, "a", "b"]
    assert [r["start"] for r in got] == [0, got[0]["n_tokens"], got[0]["n_tokens"] + 1]
    assert [r["doc_id"] for r in token_files.read_token_orc(spark, str(tmp_path / "ids"), ["b"]).collect()] == ["b"]


def test_small_conversation_ids(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id short, turn int, role string, text string")
    got = chat.chat_digests(chat.format_chats(rows, public_path("byte_bpe_50k.json"))).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got] == [(1, 2, 2)]


def test_repeated_query_ids_are_asked_once(spark):
    rows = [(i, [float(i), 1.0 / (i + 1)]) for i in range(8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([rows[4], rows[4], (4, [9.0, 9.0])], "vec_id long, embedding array<double>")
    got = sorted(nearest.nearest(vectors, queries, 3).collect(), key=lambda r: r["rank"])
    want = sorted(((-(4.0 * v[0] + 0.2 * v[1]), i) for i, v in rows if i != 4))[:3]
    assert [(r["rank"], r["vec_id"]) for r in got] == [(k + 1, i) for k, (_, i) in enumerate(want)]
    assert all(abs(r["score"] + s) < 1e-12 for r, (s, _) in zip(got, want, strict=True))


def test_no_private_scratch_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.Scratch(Session(), "x")
