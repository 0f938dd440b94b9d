"""The filter audit, packing by powers of two and vector codes against plain loops."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import binary_packing, filter_audit, vector_codes
from larkspur.llm.tokenizing import encode_ids, public_path

BPE = public_path("byte_bpe_50k.json")


# -- filter audit


def audit_by_loops(docs, labels):
    parts = {}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    for d, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": re.search("[#$%&*|]", t) is not None,
            "E": d is not None and d > least[t],
        }
        parts.setdefault(source or "", []).append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                before = set(order[:step])
                shapley[f] += len(gone)
                left = [r for r in left if f not in r[0]]
                out[part, "".join(order), step + 1] = (
                    len(left), len(gone), sum(f in r[0] and bool(before & r[0]) for r in rows),
                    sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone),
                )
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v, shapley[order[step - 1]])
    return out


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, source string, mask string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    text = F.coalesce("text", F.lit(""))
    return {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.filter_audit(d, told, filter_audit.text_filters(text)).collect()}


def test_audit_of_odd_rows(spark):
    rng = random.Random(7)
    texts = [None, "", " \t\n", "A B", "a # b", "X" * 400, " ".join(f"w{i}" for i in range(60)), "same " * 70, "é \x1c " * 55]
    texts += [" ".join(rng.choice(["aa", "BB", "cc", "d$", f"w{i}"]) for i in range(rng.randrange(40, 80))) for _ in range(40)]
    docs = [(i, rng.choice(texts), rng.choice(["s1", "s1", "s1", "s2", "", None])) for i in range(300)]
    docs += [(None, "", "s1"), (None, texts[6], None), (None, "only here", "s3"), (3, texts[6], "s1"), (3, texts[6], "s1"), docs[0], docs[0]]
    docs += [(400 + i, texts[6], "s2") for i in range(150)]  # one text has a third of all rows
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 400, 2)]
    labels += [(2, 1, 0), (2, 0, 1), (None, 1, 1), (99_999, 1, 1)]
    assert audited(spark, docs, labels) == audit_by_loops(docs, labels)


def test_audit_of_nothing_and_of_clean_documents(spark):
    assert audited(spark, [], []) == {}
    text = " ".join(f"w{i}" for i in range(80))
    got = audited(spark, [(1, text, "s")], [])
    assert len(got) == 600 and set(got.values()) == {(1, 0, 0, 0, 0, 0, 0)}


# -- powers of two


@pytest.mark.parametrize("n, want", [(1, [1]), (1024, [1024]), (2048 + 5, [1024, 1024, 4, 1]), (1023, [512, 256, 128, 64, 32, 16, 8, 4, 2, 1])])
def test_binary_lengths(n, want):
    assert binary_packing.binary_lengths(n, 1024) == want


def test_decomposition_keeps_every_id(spark):
    rng = random.Random(5)
    texts = [None, "", "x", "日本語 テキスト", "<|endoftext|>", "long " * 3000]
    texts += [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(300))) for _ in range(60)]
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts + texts[:9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, task string").repartition(5)
    got = binary_packing.decompose(docs, BPE).collect()
    want = Counter()
    for (d, t, _), own in zip(rows, encode_ids(BPE, [t or "" for _, t, _ in rows]), strict=True):
        own = np.array([*own, 0], "<u4")
        at = 0
        for n in binary_packing.binary_lengths(len(own), 1024):
            want[d, at, n, own[at : at + n].tobytes(), len(own)] += 1
            at += n
    assert Counter((r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in got) == want
    by_sequence = sorted((r["sequence_id"], r["length"]) for r in got)
    assert [s for s, _ in by_sequence] == list(range(len(got)))  # one piece each, without gaps
    assert [n for _, n in by_sequence] == sorted(n for _, n in by_sequence)  # a length's sequences are one run
    assert {r["offset"] for r in got} == {0} and all(r["length"] & (r["length"] - 1) == 0 for r in got)


def test_buckets_are_read_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(40)], "doc_id long, text string")
    sequences = binary_packing.decompose(docs, BPE)
    binary_packing.write_buckets(sequences, str(tmp_path / "b"))
    bucket = binary_packing.read_bucket(spark, str(tmp_path / "b"), 16)
    assert {len(r["ids"]) for r in bucket.collect()} == {64}
    assert all("length=16/" in f for f in bucket.inputFiles()) or "PartitionFilters: [isnotnull(length" in bucket._jdf.queryExecution().toString()
    assert bucket.count() == sequences.where("length = 16").count() > 0


def test_decomposition_of_nothing_and_wrong_capacity(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert binary_packing.decompose(empty, BPE).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        binary_packing.decompose(empty, BPE, 1000)


def test_packing_query(spark, sf_dir):
    got = binary_packing.op12_binary_packing(spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {d: np.array([*own, 0], "<u4") for d, own in zip(docs, encode_ids(BPE, [t or "" for t in docs.values()]), strict=True)}
    covered = Counter()
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        covered[r["doc_id"]] += r["length"]
    assert covered == {d: len(own) for d, own in ids.items()}


# -- vector codes


def codes_by_loops(rows, parts=16, entries=64, rounds=2):
    kept = []
    for i, label, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, label, [int(min(max(np.floor(256 * float(x)), -(2**24)), 2**24)) for x in v]))
    longest = max(len(q) for _, _, q in kept)
    width = -(-longest // parts)
    kept = [(i, label, q + [0] * (width * parts - len(q))) for i, label, q in kept]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[q[p * width : (p + 1) * width] for _, _, q in seeds] for p in range(parts)]

    def assign(q):
        out = []
        for p in range(parts):
            x = q[p * width : (p + 1) * width]
            d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        met = [assign(q) for _, _, q in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [q[p * width : (p + 1) * width] for (_, _, q), m in zip(kept, met, strict=True) if m[p][0] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, label, [m[0] for m in assign(q)], sum(m[1] for m in assign(q))) for i, label, q in kept]
    return out, books


def key(r):
    return repr(r)


@pytest.mark.parametrize("scale", [1.0, 3000.0])  # by products of doubles, by differences of integers
def test_codes_are_lloyd_s(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(i) % 3, (scale * rng.normal(size=32)).tolist()) for i in rng.permutation(150)]
    rows += [(200 + i, None, rows[0][2]) for i in range(70)]  # a vector that a third of the rows share
    rows += [(5, 1, rows[3][2]), (5, 1, [0.0] * 32), (None, 2, rows[4][2]), (300, 1, None), (301, 1, [None] * 32), (302, 1, [float("nan")] * 32)]
    rows += [(303, 1, [float("inf"), *[0.0] * 31]), (304, 0, [1.5, -2.0, 1e30, -1e30]), (305, 0, [])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, codes int")
    coded, books = vector_codes.compress(vectors.repartition(4), 16, 20)
    got = coded.collect()
    want, expected = codes_by_loops(rows, 16, 20)
    assert sorted(((r["vec_id"], r["label"], list(r["codes"]), r["error"]) for r in got), key=key) == sorted(want, key=key)
    assert books.entries.tolist() == expected
    assert int(books.counts.sum()) == 16 * len(got)
    by_label = Counter()
    for _, label, _, error in want:
        by_label[label] += error
    for r in vector_codes.with_label_error(coded).collect():
        assert r["label_error"] == by_label[r["label"]]


def test_only_changed_parts_are_shuffled(spark):
    shape = "vec_id long, q array<int>, before array<int>, codes array<int>"
    rows = [(1, [1, 2, 3, 4], [0, 1], [0, 1]), (2, [5, 6, 7, 8], [0, 1], [1, 1]), (3, [9, 9, 9, 9], [-1, -1], [0, 0])]
    got = sorted(tuple(r) for r in vector_codes.changes(spark.createDataFrame(rows, shape), 2, 2).collect())
    assert got == [(0, 0, 0, 4, 3), (0, 1, 1, 5, 6), (1, 0, 1, 9, 9)]


def test_many_labels_are_joined_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "LABEL_ROWS", 3)
    rows = [(i, None if i % 3 else i % 50, i) for i in range(200)]
    coded = spark.createDataFrame(rows, "vec_id long, label int, error long")
    sums = Counter()
    for _, label, e in rows:
        sums[label] += e
    got = vector_codes.with_label_error(coded).collect()
    assert len(got) == 200 and all(r["label_error"] == sums[r["label"]] for r in got)


def test_codes_of_nothing_and_of_few(spark):
    shape = "vec_id long, label int, embedding array<float>"
    coded, books = vector_codes.compress(spark.createDataFrame([(1, 1, None)], shape))
    assert coded.collect() == [] and books is None
    coded, books = vector_codes.compress(spark.createDataFrame([(1, 1, [0.5] * 16), (2, 1, [])], shape))
    assert [(r["vec_id"], r["error"]) for r in coded.orderBy("vec_id").collect()] == [(1, 0), (2, 0)]
    assert books.entries.shape == (16, 2, 1)
