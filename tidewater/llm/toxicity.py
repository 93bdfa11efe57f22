"""Toxicity by a linear-chain conditional random field.

Labels say which documents are toxic, not which words, so tokens are labelled first: word features (whole words and
their first letters) that stand in toxic training documents and practically never in others mark the toxic tokens, if
they do so more often than chance explains. Documents count there as far as the neighbours differ (what comes with copies
of one text has always the same ones), and the test asks no share of the toxic documents: a word of a rare language or
topic needs a number of documents that grows with the logarithm of the number of features only. A two-state chain is then trained on
hashed word features by gradient ascent on its likelihood. Forward-backward marginals of every token of a whole
document give its offending spans, and their maximum and union a score through a logistic curve fitted on the training
labels.

Training takes at most SAMPLE labelled documents of each class, picked by hash, and SAMPLE_BYTES of text, filled in the
order of that hash; that is all that reaches the driver. Chains are cut after every ROW tokens in training, while scoring
links them over the whole document. Scoring is one pass over the documents with no shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest

from .common import MEMO_WORDS, by_place, pieces, read_table, texts
from .decontaminate import words

SAMPLE = 2000
SAMPLE_BYTES = 24 << 20
THRESHOLD = 0.7
FEATURE_BITS = 18
#: Tokens in a row of the matrices that chains are laid out in; longer documents take several linked rows.
ROW = 256
ROUNDS = 60
#: A marking feature is in this many toxic documents at least (and between as many different pairs of neighbours), and
#: its rate among clean documents is at most this part of that among toxic ones.
LEAST, MOST_CLEAN = 5, 0.04
#: Share of chance finds among the marking features at most (Benjamini and Hochberg).
CHANCE = 0.05

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def features(word: bytes) -> list[bytes]:
    """The word, its first three to seven letters and its last three."""
    text = word.decode("utf-8", "replace")
    return [b"w" + word, *(b"%d" % k + text[:k].encode() for k in range(3, 8)), b"e" + text[-3:].encode()]


def feature_hashes(word: bytes) -> list[int]:
    return [xxh3_64_intdigest(f) for f in features(word)]


def slot(hashes):
    """A feature's place among the weights."""
    return np.asarray(hashes, np.uint64) >> np.uint64(64 - FEATURE_BITS)


class Rows:
    """Token scores of documents in rows of ROW tokens."""

    def __init__(self, scores: list[np.ndarray], linked: bool = True):
        size = np.array([len(s) for s in scores], np.int64)
        n = np.maximum(1, -(-size // ROW))
        self.doc = np.repeat(np.arange(len(scores)), n)
        self.block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.length = np.clip(size[self.doc] - self.block * ROW, 0, ROW)
        self.last = self.block == n[self.doc] - 1
        self.flat = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)) + np.repeat((np.cumsum(n) - n) * ROW, size)
        self.u = np.zeros((len(self.doc), ROW))
        self.u.reshape(-1)[self.flat] = np.concatenate(scores) if len(scores) else []
        self.linked = linked

    def marginals(self, start: np.ndarray, step: np.ndarray, pairs: bool = False):
        """P(toxic) of each token, documents end to end; with pairs also the expected transitions and starts."""
        e = np.exp(np.clip(self.u, -40, 40))
        rows, linked = len(e), self.linked and self.block.any()
        live = [np.flatnonzero(self.length > t) for t in range(ROW)]
        first = (self.block == 0) | (not self.linked)
        in0, in1 = np.full(rows, start[0]), np.full(rows, start[1])
        out0, out1 = np.ones(rows), np.ones(rows)
        if linked:
            # Products of each row's transfer matrices, then messages from row to row.
            m = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
            for t in range(ROW):
                k = live[t]
                if not len(k):
                    break
                moved = m[k] @ step
                if t == 0:
                    moved[first[k]] = start
                moved[:, :, 1] *= e[k, t][:, None]
                m[k] = moved / moved.max(axis=(1, 2), keepdims=True)
            # A first row's matrix holds its start in both rows.
            after = np.empty((rows, 2))
            after[first] = m[first, 0]
            for b in range(1, int(self.block.max()) + 1):
                k = np.flatnonzero(self.block == b)
                came = after[k - 1] / after[k - 1].sum(axis=1, keepdims=True)
                in0[k], in1[k] = came[:, 0], came[:, 1]
                after[k] = (came[:, None, :] @ m[k])[:, 0]
            for b in range(int(self.block.max()) - 1, -1, -1):
                k = np.flatnonzero((self.block == b) & ~self.last)
                back = (m[k + 1] @ np.stack([out0[k + 1], out1[k + 1]], axis=1)[:, :, None])[:, :, 0]
                back /= back.sum(axis=1, keepdims=True)
                out0[k], out1[k] = back[:, 0], back[:, 1]
        a = np.zeros((2, rows, ROW))
        p0, p1 = in0.copy(), in1.copy()
        for t in range(ROW):
            k = live[t]
            if not len(k):
                break
            q0, q1 = p0[k] * step[0, 0] + p1[k] * step[1, 0], p0[k] * step[0, 1] + p1[k] * step[1, 1]
            if t == 0:
                q0, q1 = np.where(first[k], start[0], q0), np.where(first[k], start[1], q1)
            q1 = q1 * e[k, t]
            z = q0 + q1
            p0[k], p1[k] = q0 / z, q1 / z
            a[0, k, t], a[1, k, t] = p0[k], p1[k]
        out = np.zeros((rows, ROW))
        moves, starts = np.zeros((2, 2)), np.zeros(2)
        for t in range(ROW - 1, -1, -1):
            k = live[t]
            if not len(k):
                continue
            w0, w1 = a[0, k, t] * out0[k], a[1, k, t] * out1[k]
            out[k, t] = w1 / (w0 + w1)
            b0, b1 = out0[k], out1[k] * e[k, t]
            if pairs and t > 0:
                joint = np.array([[a[0, k, t - 1] * step[0, 0] * b0, a[0, k, t - 1] * step[0, 1] * b1], [a[1, k, t - 1] * step[1, 0] * b0, a[1, k, t - 1] * step[1, 1] * b1]])
                moves += (joint / joint.sum(axis=(0, 1))).sum(axis=2)
            n0, n1 = step[0, 0] * b0 + step[0, 1] * b1, step[1, 0] * b0 + step[1, 1] * b1
            z = n0 + n1
            out0[k], out1[k] = n0 / z, n1 / z
        p = out.reshape(-1)[self.flat]
        if pairs:
            on = out[:, 0][self.length > 0].sum()
            starts[:] = (self.length > 0).sum() - on, on
            return p, moves, starts
        return p


def label_tokens(tokens: list[np.ndarray], toxic: list[bool], hashes: np.ndarray) -> np.ndarray:
    """Hashes of the features (words and first letters) that mark toxic documents; tokens number the rows of hashes."""
    hashes = hashes[:, :-1]

    def documents(kind: bool):
        found = [np.unique(hashes[np.unique(t)]) for t, y in zip(tokens, toxic) if y is kind]
        return np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)

    (bad, n), (clean, met) = documents(True), documents(False)
    n_bad, n_clean = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    at = np.minimum(np.searchsorted(clean, bad), max(0, len(clean) - 1))
    c = np.where(clean[at] == bad, met[at], 0) if len(clean) else np.zeros(len(bad), np.int64)
    tested = np.count_nonzero(n + c >= LEAST)
    precise = (n >= LEAST) & (c / n_clean <= MOST_CLEAN * n / n_bad)
    # Toxic documents may be longer: their share of what is counted.
    share = min(n.sum() / max(1, n.sum() + met.sum()), 1 - 1e-9)
    bad, n, c = bad[precise], n[precise], c[precise]
    places = []
    for t, y in zip(tokens, toxic):
        if y and len(t):
            around = np.append(-1, t[:-1]) * len(hashes) + np.append(t[1:], -1)
            row, column = np.nonzero(np.isin(hashes[t], bad))
            places.append(np.column_stack([hashes[t][row, column], around[row].astype(np.uint64)]))
    places = np.unique(np.concatenate(places), axis=0)[:, 0] if places else np.empty(0, np.uint64)
    # Every feature of bad has a place.
    between = np.unique(places, return_counts=True)[1]
    p = chance(np.minimum(n, between), c, share)
    ranked = np.sort(p)
    passed = ranked[ranked <= CHANCE * np.arange(1, len(p) + 1) / max(1, tested)]
    return bad[(between >= LEAST) & (p <= passed.max(initial=0))]


def chance(n: np.ndarray, c: np.ndarray, share: float) -> np.ndarray:
    """P(c or fewer of n + c documents are clean) if each is toxic by a chance of share."""
    def tail(n: int, c: int) -> float:
        whole = lgamma(n + c + 1)
        return sum(exp(whole - lgamma(j + 1) - lgamma(n + c - j + 1) + (n + c - j) * log(share) + j * log1p(-share)) for j in range(c + 1))

    pairs, at = np.unique(np.column_stack([n, c]).astype(np.int64), axis=0, return_inverse=True)
    return np.array([tail(*map(int, x)) for x in pairs])[at.ravel()] if len(pairs) else np.empty(0)


class Model:
    def __init__(self, weights, bias, start, step, curve):
        self.weights, self.bias, self.start, self.step, self.curve = weights, bias, start, step, curve

    def word_score(self, word: bytes) -> float:
        return float(self.weights[slot(feature_hashes(word))].sum() + self.bias)

    def document(self, p: np.ndarray) -> float:
        """Score from the tokens' marginals."""
        return float(self.scores(np.array([summary(p)]))[0])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -40, 40)))


def summary(p: np.ndarray) -> tuple[float, ...]:
    """Largest marginal, the chance that some token is toxic if they were apart, and logs of the expected number of
    toxic tokens and of the number of tokens."""
    if not len(p):
        return 0.0, 0.0, 0.0, 0.0
    some = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
    return float(p.max()), float(some), float(np.log1p(p.sum())), float(np.log1p(len(p)))


def train(sample: list[tuple[bytes, bool]], share: float) -> Model:
    """A model from (text, toxic) pairs; share: the toxic part of all training labels."""
    number: dict[bytes, int] = {}
    tokens = [np.array([number.setdefault(w, len(number)) for w in words(t)], np.int64) for t, _ in sample]
    toxic, vocab = [y for _, y in sample], list(number)
    hashes = np.array([feature_hashes(w) for w in vocab] or np.empty((0, 7)), np.uint64)
    slots = slot(hashes).astype(np.int64)
    marked = np.isin(hashes[:, :-1], label_tokens(tokens, toxic, hashes)).any(axis=1)
    gold = [marked[t] & y for t, y in zip(tokens, toxic)]
    # Chains of one row each: a document's rows are trained apart, and all of its text counts.
    chains = Rows([np.zeros(len(t)) for t in tokens], linked=False)
    flat, truth = np.concatenate(tokens or [np.empty(0, np.int64)]), np.concatenate(gold or [np.empty(0, bool)]).astype(float)
    laid = np.zeros(chains.u.size)
    laid[chains.flat] = truth
    laid = laid.reshape(chains.u.shape).astype(int)
    seen = np.zeros((2, 2))
    inner = np.arange(1, ROW)[None, :] < chains.length[:, None]
    np.add.at(seen, (laid[:, :-1][inner], laid[:, 1:][inner]), 1)
    begun = np.bincount(laid[:, 0][chains.length > 0], minlength=2).astype(float)
    theta = np.concatenate([np.zeros(1 << FEATURE_BITS), [-3.0], np.zeros(6)])
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    own = np.bincount(flat, truth, len(vocab))
    n = max(1.0, truth.sum())
    for r in range(1, ROUNDS + 1) if len(flat) else []:
        score = theta[slots].sum(axis=1) + theta[1 << FEATURE_BITS]
        chains.u.reshape(-1)[chains.flat] = score[flat]
        step, start = np.exp(theta[-6:-2].reshape(2, 2)), np.exp(theta[-2:])
        p, moves, starts = chains.marginals(start, step, pairs=True)
        rest = own - np.bincount(flat, p, len(vocab))
        grad = np.zeros_like(theta)
        grad[: 1 << FEATURE_BITS] = np.bincount(slots.ravel(), np.repeat(rest, slots.shape[1]), 1 << FEATURE_BITS)
        grad[1 << FEATURE_BITS] = rest.sum()
        grad[-6:-2], grad[-2:] = (seen - moves).ravel(), begun - starts
        grad = grad / n - 1e-4 * theta
        one, two = 0.9 * one + 0.1 * grad, 0.99 * two + 0.01 * grad**2
        theta += 0.3 * (one / (1 - 0.9**r)) / (np.sqrt(two / (1 - 0.99**r)) + 1e-6)
    model = Model(theta[: 1 << FEATURE_BITS], theta[1 << FEATURE_BITS], np.exp(theta[-2:]), np.exp(theta[-6:-2].reshape(2, 2)), None)
    memo = np.array([model.word_score(w) for w in vocab])
    rows = Rows([memo[t] for t in tokens])
    p = rows.marginals(model.start, model.step)
    ends = np.cumsum([0, *map(len, tokens)])
    x = np.array([summary(p[b:e]) for b, e in zip(ends, ends[1:])]).reshape(-1, 4)
    model.curve = logistic(x, np.array(toxic, float), share)
    return model


def logistic(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Weights and bias by Newton's method; classes weigh as they do among all labels, with a small penalty."""
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([*np.full(x.shape[1], 0.1), 1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), z.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
    return w


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Trains on labelled rows that aren't held out; None without labels of both kinds.

    A document with several labels is toxic if one says so; null labels and null ids don't count; a null text is empty.
    The sample is the same however the tables are laid out: texts are taken in the order of a hash of their ids while
    they fit into SAMPLE_BYTES (a text that doesn't fit is passed over), and copies of a text count once."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return None
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    # At most 2 * SAMPLE ids.
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(chosen, "doc_id")
    # In order, a sixteenth at a time, so that the driver never holds all texts that might be sampled.
    rows = rows.repartitionByRange(16, F.xxhash64("doc_id"), "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    sample, room, seen = [], SAMPLE_BYTES, set()
    for r in rows.toLocalIterator():
        if (key := (xxh3_64_intdigest(bytes(r.text)), r.toxic)) not in seen and len(r.text) <= room:
            seen.add(key)
            room -= len(r.text)
            sample.append((bytes(r.text), r.toxic == 1))
    if len({y for _, y in sample}) < 2:
        return None
    return train(sorted(sample), n[1] / (n[0] + n[1]))


class _Scorer(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        s = self[word] = self.model.word_score(word)
        return s

    def of(self, docs: list[bytes]):
        if len(self) > MEMO_WORDS // 2:
            self.clear()
        scores = [np.fromiter(map(self.__getitem__, ws), np.float64, len(ws)) for ws in map(words, docs)]
        p = Rows(scores).marginals(self.model.start, self.model.step)
        return np.split(p, np.cumsum([len(s) for s in scores])[:-1])


_SPANS = "array<struct<begin: long, end: long>>"


def _scored(docs: DataFrame, model: Model | None, threshold: float, text_col: str) -> DataFrame:
    """docs (columns c0, c1, ...) with score, predicted and spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value)
        for batch in pieces(batches, 4 << 20):
            own = texts(batch[text_col])
            found = scorer.of(own) if sent.value and own else [np.empty(0)] * len(own)
            score = sent.value.scores(np.array([summary(p) for p in found]).reshape(-1, 4)) if sent.value else np.zeros(len(own))
            spans = []
            for text, p, y in zip(own, found, score >= threshold):
                on = np.flatnonzero(p >= (min(0.5, p.max()) if y and len(p) else 0.5))
                if not len(on):
                    spans.append([])
                    continue
                at = [m.span() for m in _WORD.finditer(text)]
                cut = np.flatnonzero(np.diff(on) > 1) + 1
                spans.append([{"begin": at[k[0]][0], "end": at[k[-1]][1]} for k in np.split(on, cut)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, kind)], names=[*batch.schema.names, "score", "predicted", "spans"])

    return docs.mapInArrow(scan, "".join(f"{n} {t}, " for n, t in docs.dtypes) + f"score double, predicted int, spans {_SPANS}")


def toxicity(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score double, predicted int and spans array<struct<begin, end>> (bytes of the UTF-8 text that runs of
    tokens with a marginal of 1/2 or more take up; in a rejected document without such, those of its largest marginal).

    Null and empty texts have no tokens and get the score of a text without toxic ones. Repeated rows get equal scores.
    Without a model all scores are 0. All columns of docs stay but for columns of the three new names, which the new ones
    replace."""
    plain, name = by_place(docs)
    new = ("score", "predicted", "spans")
    stay = [i for i, c in enumerate(docs.columns) if c.lower() not in new]
    return _scored(plain, model, threshold, name("text")).select(*(f"c{i}" for i in stay), *new).toDF(*(docs.columns[i] for i in stay), *new)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs, whatever their names.

    Null and empty texts score as texts without toxic words do; repeated rows stay or go together. Without labels of both
    kinds there is no model and all rows stay."""
    plain, name = by_place(docs)
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return _scored(plain, model, threshold, name("text")).where("predicted = 0").select(*plain.columns).toDF(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), "spans")
