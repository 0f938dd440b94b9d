"""What queries return, column by column, against loops of their own; what lies in the token files."""

from __future__ import annotations

import glob
import hashlib
import random
import re

import public_tokenizers
import pyarrow.orc as orc
import pytest
import sentencepiece

from larkspur.llm import decontamination, pii, token_counts, token_files

PIECE = public_tokenizers.path("piece_bpe_32k.model")
BYTE = public_tokenizers.path("byte_bpe_50k.json")

# -- personal data


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(d := re.sub("[^0-9]", "", t)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15),
    )
    out = []
    for k, (kind, pattern, ok) in enumerate(rules):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if ok(m.group())]
    return sorted(out)


PIECES = (
    "a.b+c@mail.example.org", "x@y", "10.0.0.255", "1.2.3.4.5", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559",
    "+49 (30) 1234-567", "+1 2", "+123456789012345678", "plain", "é", "日本", "card", "call", "\n", "4111111111111111", "0.0.0.0@x.y", "+4912345678.",
)


def test_every_column_of_personal_data(spark):
    rng = random.Random(12)
    texts = [None, "", " ", *(" ".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 30))) for _ in range(150))]
    rows = [(i // 2, t, 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email int").repartition(3)
    got = pii.personal_data(docs).collect()
    want = []
    for d, t, _ in rows:
        base = base_spans(t or "")
        line = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in base)
        want.append((d, *(sum(s[2] == k for s in base) for k in ("email", "ip", "card", "phone")), hashlib.sha256(line.encode()).hexdigest()))
    assert sorted(tuple(r)[:6] for r in got) == sorted(want)
    base_of = {}
    for d, t, _ in rows:
        lines = [f"{kind}:{a}:{b}" for a, _, kind, b in base_spans(t or "")]
        base_of[d, hashlib.sha256(",".join(lines).encode()).hexdigest()] = lines
    for r in got:
        listed = r["spans"].split(",") if r["spans"] else []
        assert set(base_of[r["doc_id"], r["base_sha256"]]) <= set(listed)  # base ones stay, others may be added
        starts = [int(s.split(":")[1]) for s in listed]
        assert starts == sorted(starts) and len(set(listed)) == len(listed)


# -- benchmark passages


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_every_column_of_leaks(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [("b10", " ".join(rng.choice(vocabulary) for _ in range(25))), ("b9", "W1 w2, w3"), ("b2", None), ("b3", "!!"), ("b10x", "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    items += [(f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for k in range(12)]
    long = items[0][1].split()
    texts = [None, "", "w1 w2 w3", "w1 W2... w3 w1-w2", " ".join(long[3:20]), " ".join(["w1"] * 40), "w1 " * 9, " ".join(long).upper()]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) + " " + " ".join(long[k : k + 12]) for k in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for r in decontamination.leaks(docs, benchmark).collect():
        own = words(texts[r["doc_id"]])
        hit, longest = set(), {}
        for item, t in items:
            bench = words(t)
            n = min(10, len(bench))
            windows = {tuple(bench[i : i + n]) for i in range(len(bench) - n + 1)} if bench else set()
            met = [i for i in range(len(own) - n + 1) if tuple(own[i : i + n]) in windows] if bench else []
            for i in met:
                hit |= set(range(i, i + n))
            if met:
                best = (0, 0)
                for i in range(len(own)):
                    for j in range(len(bench)):
                        k = 0
                        while i + k < len(own) and j + k < len(bench) and own[i + k] == bench[j + k]:
                            k += 1
                        best = max(best, (k, -i))
                longest[item] = best
        assert r["n_words"] == len(own) and list(r["hits"]) == sorted(hit) and list(r["items"]) == sorted(longest)
        found = {m["item_id"]: m for m in r["matches"]}
        assert set(found) == set(longest)
        for item, m in found.items():  # a verbatim match of the item at its place, a window long at least
            bench = words(dict(items)[item])
            piece = own[m["at"] : m["at"] + m["words"]]
            assert len(piece) == m["words"] >= min(10, len(bench)) and any(bench[j : j + len(piece)] == piece for j in range(len(bench)))
            assert m["words"] <= longest[item][0]


# -- token files


def test_files_are_run_length_coded_with_bloom_filters(spark, tmp_path):
    docs = spark.createDataFrame([(3 * i, f"text {i} " * (i % 7)) for i in range(400)], "doc_id long, text string")
    path = str(tmp_path / "ids.orc")
    token_files.write_token_orc(docs, path, BYTE, files=4)
    files = sorted(glob.glob(f"{path}/part-*.orc"))
    assert len(files) == 4
    bounds = []
    for f in files:
        held = orc.ORCFile(f)
        assert held.compression == "ZSTD" and held.row_index_stride == token_files.INDEX_STRIDE
        ids = held.read(["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids)
        bounds.append((ids[0], ids[-1]))
        raw = open(f, "rb").read()
        assert len(raw) < 4 * sum(len(x) for x in held.read(["ids"]).column(0).to_pylist()) + 4096  # ids aren't stored in four bytes each
    assert bounds == sorted(bounds) and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))  # one order over all files
    found = token_files.read_token_orc(spark, path, [300, 301])
    assert {r["doc_id"] for r in found.select("doc_id").collect()} == {300}
    assert "PushedFilters: [In(doc_id, [300,301])]" in found._jdf.queryExecution().toString()


# -- token counts


@pytest.mark.parametrize("seed", range(3))
def test_texts_without_spaces_are_split_where_nothing_merges(seed):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rng = random.Random(seed)
    kana = [chr(c) for c in range(0x3041, 0x3097)]
    han = [chr(0x4E00 + rng.randrange(3000)) for _ in range(400)]
    latin = list("abc  ́。、ー゙é한글")
    text = "".join(rng.choice(rng.choice([kana, han, han, latin])) for _ in range(4000))
    inside = token_counts.seams(PIECE)
    parts = token_counts.parts_of(text, token_counts.splits_safely(PIECE), 300, inside)
    assert len(parts) > 10
    assert sum(len(sp.encode(p)) - minus for p, minus in parts) == len(sp.encode(text))
    assert max(len(p.encode()) for p, _ in parts) < 6000


def test_batches_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 500)
    seen = []
    whole = token_counts.encode_ids
    monkeypatch.setattr(token_counts, "encode_ids", lambda path, texts: seen.append([len(t.encode()) for t in texts]) or whole(path, texts))
    import pyarrow as pa

    texts = ["字" * 40, "x" * 40, "字" * 150, "", None, "é" * 120] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts)], names=["doc_id", "text"])
    (*_,) = token_counts._count(iter([batch]), PIECE, 10)
    assert all(sum(sizes) <= 500 or len(sizes) == 1 for sizes in seen) and any(len(sizes) > 1 for sizes in seen)
