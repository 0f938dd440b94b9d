"""Personal data: patterns, and a skip-chain conditional random field that carries their labels over a document."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, smallest_hashes, table, text_batches
from larkspur.llm.tokenizing import tidy

KINDS = ("email", "ip", "card", "phone")
#: Labels of a token: none, or one of KINDS.
LABELS = len(KINDS) + 1
#: At most so many documents, those with the smallest hashes of their ids, fit the weights, each whole; one that would
#: bring them to more than so many tokens in all is passed over.
MAX_DOCS = 4000
MAX_TOKENS = 500_000
#: Label, in fitting, of tokens outside base spans that repeat one inside: what they are isn't known.
UNKNOWN = -1
#: A span is added where the marginal of its label is at least this.
CERTAIN = 0.9
#: Where a corpus hardly repeats its tokens, skip potentials stay near this agreement of like labels.
SKIP_PRIOR = 3.0
DAMPING = 0.5
#: Messages have settled when none moves by more in a sweep. If they still swing after as many sweeps as the text
#: has tokens, each further PATIENCE sweeps halve their steps.
TOLERANCE = 1e-6
PATIENCE = 200

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_BLACK = re.compile(r"\S*")
_EDGE = ".,;:!?()[]{}<>\"'"

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that don't overlap within it; those that fail their check are dropped."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:  # a match's first part is the run before its @, as far as the match before allows
        start = at
        while start > last and not _LOCAL_END.match(text, start - 1):
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append((m.start(), 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not re.search("[0-9]", text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Chain:
    """The tokens of a text that hold a digit or an @, their features and the edges between them."""

    spans: list[tuple[int, int]]
    features: np.ndarray  # (tokens, FEATURES), 0 or 1
    labels: np.ndarray  # from the base spans; 0 elsewhere, or UNKNOWN
    chain: np.ndarray  # (edges, 2): tokens next to each other
    skip: np.ndarray  # (edges, 2): the same or a similar token, one occurrence after the other


FEATURES = 20


def _features(token: str) -> list[bool]:
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    before, at, after = token.partition("@")
    return [
        True,
        bool(at),
        bool(at and before and after),
        "." in after,
        token.startswith("+"),
        digits == 0,
        digits in (1, 2),
        digits in (3, 4),
        5 <= digits <= 8,
        9 <= digits <= 11,
        12 <= digits <= 19,
        digits > 19,
        letters == 0,
        letters > digits,
        token.count(".") == 3,
        "." in token,
        "-" in token,
        token.startswith("("),
        token.endswith(")"),
        token.isdigit(),
    ]


def _keys(token: str) -> set[str]:
    """What makes tokens similar: letters and digits alone, the part before an @, the digits alone."""
    plain = "".join(c for c in token.lower() if c.isalnum())
    local = "".join(c for c in token.lower().partition("@")[0] if c.isalnum()) if "@" in token[1:] else ""
    digits = "".join(c for c in token if "0" <= c <= "9")
    return {k for k in (plain, local, digits) if len(k) >= (6 if k.isdigit() else 4)}


def chain_of(text: str, base: list[Span], unknown: bool = False) -> Chain:
    spans, at = [], 0
    while m := _HINT.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = _BLACK.match(text, m.start()).end()
        at = end
        while start < end - 1 and text[start] in _EDGE and text[start] != "(":
            start += 1
        while end > start + 1 and text[end - 1] in _EDGE and text[end - 1] != ")":
            end -= 1
        spans.append((start, end))
    labels = np.zeros(len(spans), np.int64)
    k = 0
    for start, kind, end in sorted(base, key=lambda s: (s[0], -s[2])):
        while k and spans[k - 1][1] > start:
            k -= 1
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        while k < len(spans) and spans[k][0] < end:
            labels[k] = labels[k] or kind + 1
            k += 1
    seen: dict[str, int] = {}
    skip: set[tuple[int, int]] = set()
    keys = [_keys(text[a:b]) for a, b in spans]
    if unknown:
        inside = set().union(*(own for own, label in zip(keys, labels, strict=True) if label))
        labels[[not label and not inside.isdisjoint(own) for own, label in zip(keys, labels, strict=True)]] = UNKNOWN
    for i, own in enumerate(keys):
        for key in own:
            if key in seen:
                skip.add((seen[key], i))
            seen[key] = i
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= 2]
    return Chain(
        spans,
        np.array([_features(text[a:b]) for a, b in spans], np.float64).reshape(-1, FEATURES),
        labels,
        np.array(chain, np.int64).reshape(-1, 2),
        np.array(sorted(skip - set(chain)), np.int64).reshape(-1, 2),
    )


@dataclass(frozen=True)
class Field:
    unary: np.ndarray  # (FEATURES, LABELS)
    chain: np.ndarray  # (LABELS, LABELS), from the earlier to the later token
    skip: np.ndarray  # (LABELS, LABELS), symmetric


def fit(chains: list[Chain], rounds: int = 300, l2: float = 1e-3) -> Field:
    """Maximises the pseudo-likelihood: each token's label given its features and its neighbours' labels.

    UNKNOWN labels are neither fitted nor given to neighbours. The penalty draws skip potentials to SKIP_PRIOR on the diagonal, all other weights to 0.
    """
    chains = [c for c in chains if (c.labels != UNKNOWN).any()]
    if not chains:
        return Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), SKIP_PRIOR * np.eye(LABELS))
    first = np.cumsum([0, *(len(c.labels) for c in chains)])
    x, y = np.concatenate([c.features for c in chains]), np.concatenate([c.labels for c in chains])
    edges = [np.concatenate([getattr(c, n) + a for c, a in zip(chains, first, strict=False)]) for n in ("chain", "skip")]
    known = y != UNKNOWN
    one = np.where(known[:, None], np.eye(LABELS)[y], 0.0)
    sides = [np.zeros_like(one) for _ in range(4)]  # labels of the token before, after, and by skip edges
    for k, e in enumerate(edges):
        np.add.at(sides[2 * k], e[:, 1], one[e[:, 0]])
        np.add.at(sides[2 * k + 1], e[:, 0], one[e[:, 1]])
    skip = sides[2] + sides[3]
    prior = np.concatenate([np.zeros((FEATURES + LABELS, LABELS)), SKIP_PRIOR * np.eye(LABELS)])
    w = prior.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    f, f2 = FEATURES, FEATURES + LABELS
    for t in range(1, rounds + 1):
        z = x @ w[:f] + sides[0] @ w[f:f2] + sides[1] @ w[f:f2].T + skip @ w[f2:]
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - one) * (known[:, None] / known.sum())
        g_skip = skip.T @ d
        g = np.concatenate([x.T @ d, sides[0].T @ d + (sides[1].T @ d).T, (g_skip + g_skip.T) / 2]) + l2 * (w - prior) / known.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field(w[:f], w[f:f2], w[f2:])


def marginals(c: Chain, field: Field) -> np.ndarray:
    """Loopy sum-product until messages settle: (tokens, LABELS). Tokens in base spans are held at their labels."""
    unary = c.features @ field.unary
    held = c.labels > 0
    unary[held] = np.where(np.eye(LABELS)[c.labels[held]] > 0, 0.0, -50.0)
    source = np.concatenate([c.chain[:, 0], c.chain[:, 1], c.skip[:, 0], c.skip[:, 1]])
    target = np.concatenate([c.chain[:, 1], c.chain[:, 0], c.skip[:, 1], c.skip[:, 0]])
    n, s = len(c.chain), len(c.skip)
    reverse = np.concatenate([np.arange(n) + n, np.arange(n), np.arange(s) + 2 * n + s, np.arange(s) + 2 * n])
    pair = np.concatenate(
        [np.repeat(q[None], k, 0) for q, k in ((field.chain, n), (field.chain.T, n), (field.skip, s), (field.skip.T, s))]
    )
    message = np.zeros((len(source), LABELS))
    step, sweeps, moved = 1 - DAMPING, 0, np.inf if len(source) else 0.0
    while step * moved > TOLERANCE:
        sweeps += 1
        if sweeps > len(unary) and sweeps % PATIENCE == 0:
            step /= 2
        belief = unary.copy()
        np.add.at(belief, target, message)
        out = (belief[source] - message[reverse])[:, :, None] + pair
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None]).sum(1))
        new -= new.max(1, keepdims=True)
        moved = np.abs(new - message).max()
        message = (1 - step) * message + step * new
    belief = unary.copy()
    np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def possible(c: Chain, field: Field) -> np.ndarray:
    """Tokens outside base spans that could come to CERTAIN if all messages to them spoke for one label.

    A message for a label against none is a mean over its sender's labels, so it's no more than the most of these.
    """
    unary = c.features @ field.unary
    gain = unary[:, 1:] - unary[:, :1]
    for target, pair in (
        (c.chain[:, 1], field.chain), (c.chain[:, 0], field.chain.T), (c.skip[:, 1], field.skip), (c.skip[:, 0], field.skip.T)
    ):
        np.add.at(gain, target, np.maximum(0.0, (pair[:, 1:] - pair[:, :1]).max(0)))
    return (c.labels == 0) & (gain >= np.log(CERTAIN / (1 - CERTAIN)) - 1e-6).any(1)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The base spans, and all: with those that the field adds outside them, in texts without base spans too.

    Neighbouring tokens that get one label make one span.
    """
    base = base_spans(text)
    c = chain_of(text, base)
    open_ = possible(c, field)
    if not open_.any():
        return base, base
    p = marginals(c, field)
    best = p.argmax(1)
    added: list[Span] = []
    for i in np.flatnonzero(open_ & (best > 0) & (p.max(1) >= CERTAIN)).tolist():
        (start, end), kind = c.spans[i], int(best[i]) - 1
        if added and added[-1][1] == kind and start - added[-1][2] <= 1:
            start = added.pop()[0]
        added.append((start, kind, end))
    return base, sorted([*base, *added])


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


@tidy
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = []
        for text in batch.column(1).to_pylist():
            c = chain_of(text or "", base_spans(text or ""), unknown=True)
            parts = (c.features.astype(np.uint8), c.labels.astype(np.int8), c.chain.astype("<i4"), c.skip.astype("<i4"))
            blobs.append([p.tobytes() for p in parts])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(b[1]) for b in blobs], pa.int64()), *(pa.array([b[i] for b in blobs], pa.binary()) for i in range(4))],
            names=["doc_id", "tokens", "features", "labels", "chain", "skip"],
        )


def train(docs: DataFrame) -> Field:
    """Weights from the base spans of at most MAX_DOCS documents with at most MAX_TOKENS tokens, each taken whole.

    Everything collected is bounded by that.
    """
    spark, h = docs.sparkSession, F.xxhash64("doc_id", F.lit(4))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    chosen = spark.createDataFrame(smallest_hashes(ids, "doc_id", 4, MAX_DOCS).collect(), ids.schema).distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text")
    kind = ids.schema["doc_id"].dataType.simpleString()
    packed = rows.mapInArrow(_pack, f"doc_id {kind}, tokens long, features binary, labels binary, chain binary, skip binary")
    scratch = Scratch(spark, "personal-data")
    packed = scratch.keep(packed, "packed")
    sizes = packed.groupBy("doc_id").agg(F.sum("tokens").alias("n")).orderBy(h, "doc_id").collect()
    left, over = MAX_TOKENS, []
    for r in sizes:
        if r["n"] <= left:
            left -= r["n"]
        else:
            over.append((r["doc_id"],))
    if over:
        over = F.broadcast(spark.createDataFrame(over, f"doc_id {kind}"))  # at most MAX_DOCS ids
        packed = packed.join(over, "doc_id", "left_anti")
    packed = packed.select("features", "labels", "chain", "skip")
    chains = []
    for r in sorted(packed.collect(), key=lambda r: tuple(map(bytes, r))):
        chains.append(
            Chain(
                [],
                np.frombuffer(r[0], np.uint8).reshape(-1, FEATURES).astype(np.float64),
                np.frombuffer(r[1], np.int8).astype(np.int64),
                np.frombuffer(r[2], "<i4").reshape(-1, 2).astype(np.int64),
                np.frombuffer(r[3], "<i4").reshape(-1, 2).astype(np.int64),
            )
        )
    scratch.drop()
    return fit(chains)


@tidy
def _find(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [all_spans(t or "", field) for t in batch.column(1).to_pylist()]
        counts = [[sum(s[1] == k for s in base) for base, _ in rows] for k in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *(pa.array(c, pa.int64()) for c in counts),
                pa.array([hashlib.sha256(render(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                pa.array([render(spans) for _, spans in rows], pa.string()),
            ],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row's whole text.

    Counts and digest are of the base spans; `spans` holds all, added ones included, as
    kind:start:end in code points. Null and empty texts have none. Rows with equal ids are read each
    on its own; further columns are ignored; an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    field = field or train(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda b: _find(b, field),
        f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string",
    )


def redacted(text: str, field: Field) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, last = [], 0
    for start, kind, end in all_spans(text, field)[1]:
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind].upper()}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


@tidy
def _redact(batches: Iterator[pa.RecordBatch], field: Field, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t if t is None else redacted(t, field) for t in batch.column(at).to_pylist()]
        columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with the spans of personal_data replaced in `text`; all rows and columns stay, nulls too."""
    text_batches(docs.sparkSession)
    field = field or train(docs)
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda b: _redact(b, field, at), docs.schema)


def op4_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
