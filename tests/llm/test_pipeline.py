"""The corpus pipeline's stages and run() against plain loops over a small corpus."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import components_by_all_pairs, plain_leaks, plain_spans
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import pii, toxicity
from larkspur.llm.tokenizing import public_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PASSAGE = " ".join(f"item{i}" for i in range(12))


def corpus():
    rng = np.random.default_rng(8)
    texts, labels = [], []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 300, 30)]
        if i % 4 == 0:
            words[::3] = ["vile", "scum"] * 5
        texts.append(" ".join(words))
        labels.append((i, 1, int(i % 4 == 0)))
    rows = list(enumerate(texts))
    rows += [(40, texts[1]), (41, texts[2] + " end"), (42, "x " + PASSAGE + " y"), (43, f"mail a.b@c.example or call +1 (988) 555-2485 {texts[3][:40]}")]
    # a row twice, one id with a copy and a text of its own that has a copy, nulls, and more than one sequence of tokens
    rows += [rows[5], (44, texts[6]), (44, "own " + texts[7][::-1]), (45, "own " + texts[7][::-1]), (46, None), (46, None), (47, ""), (None, texts[9])]
    rows += [(None, "none " + texts[10][::-1]), (None, None), (48, " ".join(f"long{i}" for i in range(900)))]
    docs = [(i, t, "en", "web", len(t or "")) for i, t in rows]
    return docs, labels + [(1, None, None), (None, 1, 1)], [(1, PASSAGE), (2, None)]


def key(rows):
    return Counter(tuple(r) for r in rows)


def one_of_each_group(docs):
    parts, kept = defaultdict(list), []
    for d, (_, _, p) in zip(docs, components_by_all_pairs([d[1] for d in docs], 5, 80, 100), strict=True):
        parts[p].append(d)
    for own in parts.values():
        kept.append(min(own, key=lambda d: (d[0] is None, d[0] or 0, d[1] or "")))
    return kept


def check_packed(got, docs):
    tokenizer = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    want = Counter()
    for d in docs:
        total = len(tokenizer.encode(d[1] or "", add_special_tokens=False).ids) + 1
        first, start, piece = total % 1024 or 1024, 0, 0
        while start < total:
            want[d[0], piece, start, min(first if not piece else 1024, total)] += 1
            start, piece = start + (1024 if piece else first), piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == want
    spans = defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    for own in spans.values():
        own.sort()
        assert own[0][0] >= 0 and own[-1][1] <= 1024
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    docs, labels, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_and_run(spark, folder):
    docs, labels, items = corpus()
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    frame = lambda rows: spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.train(frame(docs), spark.read.parquet(f"{folder}/labels.parquet"))
    clean = [d for d in docs if model.score(d[1]) < 0.5]
    got = stages["toxicity"](spark, frame(docs), folder)
    assert tuple(got.columns) == COLUMNS and key(got.collect()) == key(clean)
    toxic = {i for i, _, t in labels if t and i is not None}
    assert toxic.isdisjoint(d[0] for d in clean) and {1, 2, 3, 5, 43, 44} <= {d[0] for d in clean}

    unique = one_of_each_group(clean)
    got = stages["near_duplicates"](spark, frame(clean), folder)
    assert tuple(got.columns) == COLUMNS and key(got.collect()) == key(unique)
    assert len(unique) < len(clean) and any(d[0] == 44 for d in unique)

    apart = [d for d in unique if not plain_leaks(d[1], [i for i in items if i[1]])[1]]
    got = stages["decontamination"](spark, frame(unique), folder)
    assert tuple(got.columns) == COLUMNS and key(got.collect()) == key(apart)
    assert {d[0] for d in unique} - {d[0] for d in apart} == {42}

    field = pii.train(frame(apart))
    hidden = []
    for d in apart:
        text, last, out = d[1] or "", 0, ""
        for a, k, b in pii.all_spans(text, field)[1]:
            if a >= last:
                out += text[last:a] + f"[{pii.KINDS[k].upper()}]"
            last = max(last, b)
        text = None if d[1] is None else out + text[last:]
        hidden.append((d[0], text, *d[2:4], None if text is None else len(text)))
        assert plain_spans(text or "") == []
    got = stages["personal_data"](spark, frame(apart), folder)
    assert tuple(got.columns) == COLUMNS and key(got.collect()) == key(hidden)
    assert any((d[1] or "").startswith("mail [EMAIL] or call [PHONE]") for d in hidden)

    packed = stages["packing"](spark, frame(hidden), folder).collect()
    check_packed(packed, hidden)
    assert max(r["piece"] for r in packed) > 0
    whole = corpus_pipeline.run(spark, folder).collect()
    check_packed(whole, hidden)
    assert len({r["sequence_id"] for r in whole}) == len({r["sequence_id"] for r in packed})
