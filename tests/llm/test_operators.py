"""Joins, leaks, shards, chats, neighbours, personal data and toxicity against plain loops."""

from __future__ import annotations

import hashlib
import re
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import chat, common, components, decontamination, nearest, ngram_join, pii, sharding, toxicity


def texts(seed=1, groups=25):
    rng = np.random.default_rng(seed)
    out = [None, "", " \t ", "one", "One", "one two", "b" * 5000 + " x"]
    for _ in range(groups):
        base = [f"w{i}" for i in rng.integers(0, 500, rng.integers(3, 120))]
        for _ in range(rng.integers(1, 6)):
            own = list(base)
            for _ in range(rng.integers(0, 3)):
                own[rng.integers(0, len(own))] = "edit"
            out.append(" ".join(own))
    return out


def components_by_all_pairs(rows, n, num, den):
    sets = []
    for t in rows:
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    part = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            old, new = part[b], part[a]
            part = [new if p == old else p for p in part]
    first = {p: part.index(p) for p in part}
    return [(i, len(sets[i]), first[p]) for i, p in enumerate(part)]


@pytest.mark.parametrize("n, similarity", [(3, (90, 100)), (5, (80, 100)), (2, (60, 100))])
def test_join_is_exact(spark, n, similarity):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, node string")
    got = sorted(tuple(r) for r in ngram_join.ngram_join(docs, n, similarity).collect())
    assert got == components_by_all_pairs(rows, n, *similarity)


def test_allocation_keeps_every_similar_pair():
    rule = ngram_join.Rule(1, 60, 100)
    rng = np.random.default_rng(2)
    costs = {k: {0: 1e9, 1: 1e8} for k in range(20)}
    allocation = ngram_join.allocate(costs, dict.fromkeys(costs, 1.0), {k: ngram_join.scheme(rule, k)[0] for k in costs})
    assert allocation.skipped
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, rng.integers(12, 60), np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.85], rng.integers(0, 2**64, 2, np.uint64)))
        if not rule.linked(len(np.intersect1d(a, b)), len(a) + len(b)) or len(a) == len(np.intersect1d(a, b)) == len(b):
            continue
        plain = [ngram_join.signatures(x, rule, allocation)[0] for x in (a, b)]
        (sa, ka), (sb, kb) = (ngram_join.neighbourhoods(x, rule, allocation) for x in (a, b))
        deep = np.intersect1d(sa[ka == 0], sb).size + np.intersect1d(sa, sb[kb == 0]).size
        assert np.intersect1d(*plain).size or deep


def family(seed, copies, length):
    """Copies of one text that differ in up to an eighth of their words, some edits shared: several components."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(length)]
    out = []
    for _ in range(copies):
        own = list(base)
        for at in rng.integers(0, length, rng.integers(0, length // 8)):
            own[at] = f"e{rng.integers(0, 3)}"
        for at in sorted(rng.integers(0, len(own), rng.integers(0, 3)), reverse=True):
            del own[at]
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("n", "similarity"), [(3, (90, 100)), (5, (80, 100)), (1, (60, 100))])
def test_sketches_settle_no_linked_pair(n, similarity):
    rule, rng = ngram_join.Rule(n, *similarity), np.random.default_rng(7)
    owns = []
    for size in (0, 1, 2, 3, 9, 40, 41, 300, 700):
        base = np.sort(rng.integers(0, 2**64, size, np.uint64))
        owns.append(base)
        for share in (0.02, 0.05, 0.1, 0.2, 0.5):
            kept = base[rng.random(size) >= share]
            owns.append(np.sort(np.append(kept, rng.integers(0, 2**64, size - len(kept), np.uint64))))
            owns.append(kept)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(owns)), pa.int64()), pa.array([x.view(np.int64).tolist() for x in owns], pa.list_(pa.int64()))],
        names=["node", "own"],
    )
    (found,) = ngram_join._sketches(iter([batch]), rule)
    marks = [np.frombuffer(x, np.uint16) for x in found.column(2).to_pylist()]
    settled = 0
    for i, x in enumerate(owns):
        for j, y in enumerate(owns[:i]):
            if not len(x) or not len(y):
                continue
            common = len(np.intersect1d(x, y))
            apart, cells = ngram_join._apart(marks[i], marks[j], len(x), len(y), rule)
            assert not (apart and rule.linked(common, len(x) + len(y)))
            assert set(ngram_join._shared(x, y, rule).tolist()) <= set(cells)
            if len(x) == len(y) >= 300 and common < 0.55 * len(x):  # far apart, so a sketch is to tell
                assert apart
                settled += 1
    assert settled


@pytest.mark.parametrize("n, similarity", [(3, (90, 100)), (5, (80, 100)), (2, (85, 100))])
@pytest.mark.parametrize("exchanged", [False, True])
def test_large_groups_are_exact(spark, monkeypatch, n, similarity, exchanged):
    rows = family(1, 90, 80) + family(2, 40, 200) + family(3, 40, 30) + ["other text of its own", None]
    if exchanged:  # one-deletion neighbourhoods wherever a scheme has two segments
        plain = ngram_join.allocate
        monkeypatch.setattr(
            ngram_join, "allocate", lambda costs, prices, m, fixed: plain(costs, dict.fromkeys(prices, 0.0), m)
        )
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.ngram_join(docs, n, similarity).collect())
    assert got == components_by_all_pairs(rows, n, *similarity)
    assert len({r[2] for r in got}) > 5


def test_of_large_groups_only_first_differences_are_listed(spark, monkeypatch):
    rng, passage = np.random.default_rng(8), [f"p{i}" for i in range(60)]
    rows = [" ".join(passage + [f"o{x}" for x in rng.integers(0, 10**6, 40)]) for _ in range(120)]
    rows += [f"{r} end" for r in rows[:20]] + [r.replace("p30", "q") for r in rows[20:40]]
    keep, seen = common.Scratch.keep, {}

    def counted(scratch, df, name, **more):
        out = keep(scratch, df, name, **more)
        if name in ("diffs", "firsts", "further"):
            seen[name] = out.selectExpr("sum(d)").first()[0] if name == "diffs" else out.count()
        return out

    monkeypatch.setattr(common.Scratch, "keep", counted)
    monkeypatch.setattr(ngram_join.Join, "cut", lambda self, open_: open_.select("a", "b", "shared"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.ngram_join(docs, 5, (80, 100)).collect())
    assert got == components_by_all_pairs(rows, 5, 80, 100)
    assert seen["diffs"] > 5000 and 0 < seen["firsts"] < 0.5 * seen["diffs"]
    assert seen["further"] < 200  # of 9,730 pairs


@pytest.mark.parametrize("counted", [False, True])
def test_linked_sets_have_first_differences_in_common(counted):
    rule, rng = ngram_join.Rule(5, 80, 100), np.random.default_rng(9)
    pivot, passage = rng.integers(0, 2**62, 90), rng.integers(0, 2**62, 60)
    sets = []
    for _ in range(60):
        own = np.append(passage, rng.integers(0, 2**62, 80))
        sets += [own, np.append(own[rng.random(140) < rng.uniform(0.8, 1)], rng.integers(0, 2**62, 9))]
    apart = [np.setxor1d(x, pivot) for x in sets]
    d = [len(x) for x in apart]
    most = [(n + n * 100 // 80) * 20 // 180 for n in map(len, sets)]
    least = [max(1, x - y) for x, y in zip(d, most, strict=True)]
    e, n = np.unique(np.concatenate(apart), return_counts=True)
    keys = ngram_join._element_keys(np.zeros(len(e), np.int64), e)
    order = np.argsort(keys)
    usual = (keys[order], n[order]) if counted else (keys[:0], n[:0])
    columns = [[0] * len(d), range(len(d)), range(len(d)), map(len, sets), d, least]
    batch = pa.RecordBatch.from_arrays(
        [*(pa.array(list(c), pa.int64()) for c in columns), pa.array(apart, pa.list_(pa.int64()))],
        names=["wide", "node", "part", "s", "d", "least", "apart"],
    )
    (found,) = ngram_join._firsts(iter([batch.slice(0, 50)]), *usual)
    (rest,) = ngram_join._firsts(iter([batch.slice(50)]), *usual)
    rows = found.to_pylist() + rest.to_pylist()
    assert len(rows) < 0.5 * sum(d)
    first = [{r["e"]: r["at"] for r in rows if r["node"] == i} for i in range(len(d))]
    linked = 0
    for i, j in combinations(range(len(d)), 2):
        total = len(sets[i]) + len(sets[j])
        if rule.linked(len(np.intersect1d(sets[i], sets[j])), total):
            need = max(1, (d[i] + d[j] - rule.difference(total) + 1) // 2)
            both = [c for c in first[i].keys() & first[j].keys() if min(d[i] - first[i][c], d[j] - first[j][c]) > need - ngram_join.TOGETHER]
            assert len(both) >= min(need, ngram_join.TOGETHER)
            linked += 1
    assert linked > 20


@pytest.mark.parametrize(("n", "similarity"), [(3, (90, 100)), (5, (80, 100)), (1, (60, 100))])
def test_linked_sets_share_more_segments_than_both_may_leave_out(n, similarity):
    rule, rng, linked = ngram_join.Rule(n, *similarity), np.random.default_rng(5), 0
    for size in (2, 5, 9, 20, 41, 90, 300, 700):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**64, size, np.uint64))
            new = rng.integers(0, 2**64, rng.integers(0, 2 + size // 30), np.uint64)
            b = np.unique(np.append(a[rng.random(size) < rng.choice([0.9, 0.97, 0.99])], new))
            if not len(b) or not rule.linked(len(np.intersect1d(a, b)), len(a) + len(b)) or len(a) == len(b) == len(np.intersect1d(a, b)):
                continue
            linked += 1
            spares = []
            for own in (a, b):
                batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([own.view(np.int64).tolist()])], names=["node", "own"])
                spares.append({x >> 32: x & 0xFFFFFFFF for x in next(ngram_join._sketches.__wrapped__(iter([batch]), rule)).column(3)[0].as_py()})
            k = min(max(x) for x in spares)  # the scheme in which the pair is to meet
            shared = [c for c in ngram_join._shared(a, b, rule).tolist() if c >> 32 == k]
            assert 0 in {c & 0xFFFFFFFF for c in shared} or len(shared) > spares[0][k] + spares[1][k]
    assert linked > 50


def test_open_ties_are_cut_as_far_as_segments_may_be_left_out():
    cell = lambda k, i: (k << 32) + i + 1
    rows = [
        (1, ngram_join.TREE, 7, [cell(3, 0)]),
        (1, ngram_join.TREE, 8, [cell(3, 0), cell(3, 1)]),
        (1, ngram_join.TREE, 9, [cell(3, 1), cell(3, 2), cell(3, 3)]),  # a third and a fourth segment, two may go
        (2, ngram_join.TREE, 7, [cell(2, 5)]),  # nothing to spare in that scheme
        (3, ngram_join.STANDS, 7, [cell(3, 0)]),
        (4, ngram_join.TREE, 7, [3 << 32]),  # a poor set's
    ]
    node, tree, b, shared = zip(*rows, strict=True)
    columns = [pa.array(node), pa.array(tree, pa.int32()), pa.array([[(3 << 32) + 2]] * len(rows)), pa.array(node), pa.array(b), pa.array(shared)]
    batch = pa.RecordBatch.from_arrays(columns, names=["node", "tree", "spare", "a", "b", "shared"])
    left = [(r["a"], r["b"]) for cut in ngram_join._cut(iter([batch.slice(0, 2), batch.slice(2)])) for r in cut.to_pylist()]
    assert left == [(1, 9), (2, 7), (3, 7), (4, 7)]


def test_a_shared_passage_makes_no_group(spark, monkeypatch):
    """Unlinked texts with a passage in common, which before were compared with each other as one large group."""
    grouped, large = [], ngram_join.Join.further
    monkeypatch.setattr(ngram_join.Join, "further", lambda join, members, *rest: grouped.append(members.count()) or large(join, members, *rest))
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [f"{' '.join(f'w{x}' for x in rng.integers(0, 10**6, 170))} {passage}" for _ in range(120)]
    rows += [rows[i].replace(" w", " v", 1) for i in range(0, 120, 10)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.ngram_join(docs, 5, (80, 100)).collect())
    assert got == components_by_all_pairs(rows, 5, 80, 100)
    assert len({r[2] for r in got}) == 120 and not grouped


@pytest.mark.parametrize("nulls", [3, 2, 1])
def test_rows_with_null_ids_link_others(spark, nulls):
    """Every nulls-th row has a null id: with 2 and 3, bucket heads among them; with 1, there are no other rows."""
    rows = family(1, 60, 80) + family(4, 30, 40) + [None, "", "alone"]
    docs = [(None if i % nulls == 0 else i, t, "x") for i, t in enumerate(rows)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = sorted((tuple(r) for r in ngram_join.ngram_join(frame, 3, (90, 100)).collect()), key=repr)
    parts = components_by_all_pairs(rows, 3, 90, 100)
    first = {}
    for (i, _, _), (_, _, p) in zip(docs, parts, strict=True):
        first[p] = min((x for x in (first.get(p), i) if x is not None), default=None)
    want = [(d[0], n, first[p]) for d, (_, n, p) in zip(docs, parts, strict=True)]
    assert got == sorted(want, key=repr)
    assert nulls == 1 or any(a is None and c is not None for a, _, c in got)


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    # 2 carries a copy of 1's text and one that leads a group of its own; 7 has one text twice and one without words
    docs = [(1, a), (2, a + " end"), (2, b), (3, b + " end"), (4, b), (7, c), (7, c), (7, c.upper()), (7, " "), (7, None), (8, d)]
    docs += [(None, a), (None, d + " end"), (None, "alone " + c[::-1]), (None, "alone " + c[::-1]), (9, None), (9, None)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, node string")
    got = [tuple(r) for r in ngram_join.without_near_duplicates(frame).collect()]
    parts = [p for _, _, p in components_by_all_pairs([t for _, t in docs], 5, 80, 100)]
    want = []
    for p in sorted(set(parts)):
        own = sorted((i is None, i or 0, t or "", i, t, "x") for (i, t), q in zip(docs, parts, strict=True) if q == p)
        want.append(own[0][3:])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert (2, b, "x") in got


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert ngram_join.ngram_join(docs).collect() == []
    assert sharding.interleave(docs).collect() == []
    assert pii.personal_data(docs).collect() == []
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(docs, items).collect() == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(docs, toxicity.train(docs, labels)).collect() == []
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(vectors, vectors).collect() == []
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_digests(chat.format_chats(chats, BYTE)).collect() == []


def plain_leaks(text, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, found = split(text), set(), set()
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            window = w[s : s + 10]
            for p in range(len(doc) - len(window) + 1):
                if doc[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    found.add(str(i))
    return len(doc), sorted(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_leaks(spark, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    long = " ".join(f"w{i}" for i in range(15))
    items = [(1, long), (2, "Short item"), (3, None), (10, "!!"), (2, "Short item"), (4, "é ß w1")]
    docs = ["", None, f"x {long} y", "a short, ITEM b", " ".join(f"w{i}" for i in range(9)), "short " * 3 + "item", "É é ß w1 w1", f"{long} {long}"]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, hits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["hits"], r["items"]) for r in decontamination.leaks(rows, bench).collect()}
    assert got == {i: plain_leaks(t, items) for i, t in enumerate(docs)}
    clean = {r["doc_id"] for r in decontamination.decontaminate(rows, bench).collect()}
    assert clean == {i for i, (_, hits, _) in got.items() if not hits}


def test_shards(spark):
    rows = [(i, "t" * (i % 7) if i % 11 else None, "hot" if i % 3 else (f"s{i % 5}" if i % 2 else None)) for i in range(1001)]
    got = sharding.interleave(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string")).collect()
    slots = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(16)]
    assert all(own == list(range(len(own))) for own in slots)
    assert max(map(len, slots)) - min(map(len, slots)) <= 1
    hot = [sum(r["shard"] == s and r["doc_id"] % 3 > 0 for r in got) for s in range(16)]
    assert max(hot) - min(hot) <= 2


BYTE = __import__("public_tokenizers").path("byte_bpe_50k.json")
HARD = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s>", "", None, "  lead", "\U0001f600 é\n\n", "<<SYS>><|endoftext|>[", "a" * 3000]


def test_chats(spark):
    rows = [(c, t, ["user", "assistant", "system", None][t % 4], HARD[(c + t) % len(HARD)]) for c in range(6) for t in range(9)]
    rows += [(6, 0, "assistant", "tie"), (6, 0, "assistant", "tie"), (6, None, "<s>", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(frame, BYTE)).collect()}
    for c in range(7):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(own), len(loss))
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_escapes_come_back():
    for t in [x or "" for x in HARD] + ["[\\INST]", "[\\\\/INST]<s", "<\\\\\\/s>"]:
        escaped = chat.TEMPLATE.escape(t)
        assert chat.TEMPLATE.unescape(escaped) == t
        assert not any(m in escaped for m in chat.TEMPLATE.marks)


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:400] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect()
    hit = 0
    for q in range(0, 3000, 20):
        score = (x.astype(np.float64) * x[q].astype(np.float64)).sum(1)
        score[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -score))[:20]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(abs(r["score"] - score[r["vec_id"]]) < 1e-12 for r in own)
        hit += len({r["vec_id"] for r in own} & set(want.tolist()))
    assert hit / (150 * 20) >= 0.95


@pytest.mark.parametrize("noise", [0.002, 0.05])
def test_full_blocks_with_near_copies_miss_no_neighbour(noise):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(nearest.BLOCK_ROWS + 5000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    crowd = np.arange(len(x)) % 3 == 0
    x[crowd] = x[0] + noise * rng.normal(size=(crowd.sum(), 64))
    x[~crowd & (rng.random(len(x)) < 0.01)] *= -3
    x = x.astype(np.float32)
    ids = rng.permutation(len(x))
    asked = np.append(np.arange(0, 60, 3), np.arange(1, 60, 3))
    quantiser = nearest.train(x[:2000])
    # a group of a full block and one of the rest, each followed by all queries, in batches that cut across them
    full = nearest.BLOCK_ROWS
    order = np.concatenate([np.arange(full), asked, np.arange(full, len(x)), asked])
    group = np.repeat([0, 0, 1, 1], [full, len(asked), len(x) - full, len(asked)])
    asks = np.repeat([0, 1, 0, 1], [full, len(asked), len(x) - full, len(asked)])
    parts = []
    for i in range(0, len(order), 9000):
        own = order[i : i + 9000]
        columns = [pa.array(group[i : i + 9000]), pa.array(asks[i : i + 9000]), pa.array(ids[own]), pa.array(list(x[own]))]
        parts.append(pa.RecordBatch.from_arrays(columns, names=["grp", "asks", "vec_id", "embedding"]))
    found = nearest._scan(iter(parts), quantiser, 20)
    got = [r for batch in found for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    for k in asked:
        score = (x.astype(np.float64) * x[k].astype(np.float64)).sum(1)
        best = [i for i in np.lexsort((ids, -score))[:21] if i != k][:20]
        own = sorted((r for r in got if r[0] == ids[k]), key=lambda r: (-r[2], r[1]))
        assert [r[1] for r in own[:20]] == ids[best].tolist()


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        out += [(m.start(), 1, m.end())] * all(int(p) <= 255 for p in m[0].split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end())] * (12 <= len(d) <= 19 and pii.luhn(d))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        out += [(m.start(), 3, m.end())] * (9 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
    return sorted(out)


def test_personal_data(spark):
    cases = ["", "a@b@c.com x@y.z@w.v", "@@a.b@c.d", "1.2.3.4.5 300.1.1.1", "a.b@c..d", "4111 1111 1111 1111 1", "+1 (988) 555-2485", "é@a.b z%y@a-b.c 1.1.1.000255"]
    assert [pii.base_spans(t) for t in cases] == [plain_spans(t) for t in cases]
    docs = [(i, f"call +1 (988) 555-2485 now. yes 555-2485 it is, in 1988 {i}") for i in range(30)] + [(30, None), (31, "none at 1999")]
    field = pii.train(spark.createDataFrame(docs, "doc_id long, text string"))
    base, spans = pii.all_spans(docs[0][1], field)
    assert set(base) <= set(spans) and len(base) == 1
    assert pii.all_spans("none at 1999", field) == ([], [])
    out = {r[0]: r[1] for r in pii.redact(spark.createDataFrame(docs, "doc_id long, text string"), field).collect()}
    assert out[30] is None and out[31] == "none at 1999" and out[0].startswith("call [PHONE] now.")


def test_field_adds_spans(spark):
    filler = " ".join(f"word {i}" for i in range(40))
    docs = [(i, f"call +1 (988) 555-{2000 + i} now. {filler} again 555-{2000 + i} or 5552000x, in {1900 + i}") for i in range(60)]
    field = pii.train(spark.createDataFrame(docs, "doc_id long, text string"))
    text = docs[7][1]
    base, spans = pii.all_spans(text, field)
    assert [text[a:b] for a, _, b in base] == ["+1 (988) 555-2007"]
    assert [(text[a:b], pii.KINDS[k]) for a, k, b in spans if (a, k, b) not in base] == [("555-2007", "phone")]
    alone = f"{filler} ask at (988) 555-2001 in 1999"
    assert pii.base_spans(alone) == []
    assert [alone[a:b] for a, _, b in pii.all_spans(alone, field)[1]] == ["(988) 555-2001"]
    c = pii.chain_of(text, base, unknown=True)
    assert [text[a:b] for (a, b), label in zip(c.spans, c.labels, strict=True) if label == pii.UNKNOWN] == ["555-2007"]


def test_fitting_takes_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_TOKENS", 3000)
    long = "to a.b@c.example " + " ".join(str(10**6 + i) for i in range(2500)) + " a.b@c.example."
    rows = [(1, long), (2, "4 " * 4000), (3, "call +1 (988) 555-2485 now"), (4, None)]
    seen = []
    monkeypatch.setattr(pii, "fit", lambda chains: seen.extend(chains))
    pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [pii.chain_of(t or "", pii.base_spans(t or "")) for i, t in rows if i != 2]
    assert sorted(len(c.labels) for c in seen) == sorted(len(c.labels) for c in want) == [0, 3, 2502]
    assert sorted(len(c.skip) for c in seen) == [0, 0, 1]


def test_labels_reach_distant_repeats():
    n = 60
    links = np.stack([np.arange(n - 1), np.arange(1, n)], 1)
    features = np.zeros((n, pii.FEATURES))
    features[:, 0] = 1
    field = pii.Field(np.zeros((pii.FEATURES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), 3 * np.eye(pii.LABELS))
    field.unary[0, 1] = 0.4
    labels = np.zeros(n, np.int64)
    labels[0] = 1
    got = pii.marginals(pii.Chain([], features, labels, links[:0], links), field)
    unary = np.exp(features @ field.unary)
    unary[0] = np.eye(pii.LABELS)[1]
    before, after = [unary[0]], [np.ones(pii.LABELS)]  # exact on a chain: forwards and backwards
    for i in range(1, n):
        before.append(unary[i] * (np.exp(field.skip).T @ before[-1]))
        after.append(np.exp(field.skip) @ (after[-1] * unary[n - i]))
    want = np.array(before) * np.array(after[::-1])
    want /= want.sum(1, keepdims=True)
    assert np.abs(got - want).max() < 1e-3
    assert (want[:, 1] >= pii.CERTAIN).sum() > 40


def test_toxicity_on_the_held_out_fold(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scores = toxicity.toxicity_scores(docs, toxicity.train(docs, labels)).join(labels, "doc_id")
    rows = scores.where(toxicity.held_out(scores["doc_id"])).select("toxic", "toxic_predicted").collect()
    assert sum(r[0] == r[1] for r in rows) / len(rows) >= 0.95


def test_components(spark, tmp_path):
    """Paths, a hub of more rows than go by a shuffle, loops, repeats, and no links at all."""
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(100, 130)] + [(7, i) for i in range(1000, 1300)] + [(5, 5), (9, 8), (8, 9)]
    links += [(int(a), int(b)) for a, b in rng.integers(2000, 2100, (60, 2))]
    part = {x: x for pair in links for x in pair}
    for a, b in links:
        old, new = max(part[a], part[b]), min(part[a], part[b])
        part = {k: new if v == old else v for k, v in part.items()}
    scratch = common.Scratch(spark, "test")
    got = components.components(spark.createDataFrame(links, "a long, b long"), scratch, "x").collect()
    assert {r[0]: r[1] for r in got} == {k: v for k, v in part.items() if k != v}
    assert components.components(spark.createDataFrame([], "a long, b long"), scratch, "y").collect() == []


def test_components_contract_before_they_go_round(spark, monkeypatch):
    """A table that one task holds takes one; of larger ones the rounds find the same."""
    rng = np.random.default_rng(5)
    links = [(i, i + 1) for i in range(60)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (150, 2))]
    table = spark.createDataFrame(links, "a long, b long").repartition(3)
    found = []
    for chunk, kept in ((1 << 17, {"x-0", "x-1"}), (16, None)):
        monkeypatch.setattr(components, "CHUNK", chunk)
        scratch = common.Scratch(spark, "test")
        found.append(sorted(map(tuple, components.components(table, scratch, "x").collect())))
        assert kept in (None, scratch.kept)
    part = {x: x for pair in links for x in pair}
    for a, b in links:
        old, new = max(part[a], part[b]), min(part[a], part[b])
        part = {k: new if v == old else v for k, v in part.items()}
    assert found == [sorted((k, v) for k, v in part.items() if k != v)] * 2


def test_toxicity_fit_holds_two_bytes_an_n_gram(monkeypatch):
    """Packed n-grams come back as they were, and what a fit holds stays within bounds."""
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(97, 123, 700))) for _ in range(2000)]
    index = [toxicity.features(t) for t in [*texts[:5], "", None]]
    assert (toxicity._unpacked(*toxicity._packed(index)) == np.concatenate(index)).all()
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    tracemalloc.start()
    toxicity.fit([(t, i % 2) for i, t in enumerate(texts)], 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n_grams = sum(len(toxicity.features(t)) for t in texts)
    assert peak < 14 * (8 << toxicity.BITS) + 2.5 * n_grams  # some rows of numbers as long as the model, and two bytes each


def test_toxicity_fit_against_a_dense_matrix():
    """Rows of several blocks, empty and null texts and repeats among them."""
    words = ["Ab", "cde", "fgh ij", "Zürich", "kkkk", ""]
    texts = [None, "", *(" ".join(words[(i * k) % 6] for k in range(1, 2 + i % 9)) for i in range(600))]
    rows = [(t, int(i % 3 == 0)) for i, t in enumerate(texts)]

    def grams(text):
        codes = [ord(c.lower() if "A" <= c <= "Z" else c) for c in f" {text or ''} "]
        found = set()
        for n in (3, 4, 5):
            for at in range(len(codes) - n + 1):
                h = n
                for c in codes[at : at + n]:
                    h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
                h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) % 2**64
                found.add(h >> (64 - toxicity.BITS))
        return found

    own = [grams(t) for t, _ in rows]
    names = sorted(set().union(*own))
    x, y = np.array([[f in o for f in names] for o in own], float), np.array([r[1] for r in rows], float)
    ratio = np.log((1 + y @ x) / (y.sum() + 2)) - np.log((1 + (1 - y) @ x) / ((1 - y).sum() + 2))
    x, share = x * ratio, np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    theta, m, v = np.append(np.full(len(names), 0.1), 0.0), 0.0, 0.0
    for t in range(1, toxicity.EPOCHS + 1):
        error = (1 / (1 + np.exp(-(x @ theta[:-1] + theta[-1]))) - y) * share
        g = np.append(error @ x + toxicity.L2 * theta[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    z = x @ theta[:-1] + theta[-1] + np.log(0.2 / 0.8)
    model = toxicity.fit(rows, 0.2)
    assert np.allclose([model.score(t) for t, _ in rows], 1 / (1 + np.exp(-z)), atol=1e-4)
