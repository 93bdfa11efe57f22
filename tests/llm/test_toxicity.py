import itertools
import math

import numpy as np
import pytest

from tidewater.llm import toxicity as T


def brute_marginals(u, start, step):
    """By enumeration of all labellings."""
    total, on = 0.0, np.zeros(len(u))
    for y in itertools.product((0, 1), repeat=len(u)):
        w = start[y[0]] * np.exp(sum(a for a, b in zip(u, y) if b))
        for a, b in zip(y, y[1:]):
            w *= step[a, b]
        total += w
        on += w * np.array(y)
    return on / total


def test_marginals_against_enumeration(monkeypatch):
    monkeypatch.setattr(T, "ROW", 4)
    rng = np.random.default_rng(1)
    docs = [rng.normal(size=n) for n in (1, 4, 5, 11, 0, 8, 3)]
    start, step = np.array([0.7, 0.4]), np.array([[1.2, 0.3], [0.5, 2.0]])
    got = np.split(T.Rows(docs).marginals(start, step), np.cumsum([len(d) for d in docs])[:-1])
    for d, p in zip(docs, got):
        if len(d):
            assert p == pytest.approx(brute_marginals(d, start, step))


def test_rare_words_mark_and_copied_or_chance_ones_do_not():
    """'kwyjibo' stands in 25 of 2,000 toxic documents (1.25 %), 'zanzibar' in 25 near copies of one passage, 'quokka' in 6."""
    rng = np.random.default_rng(3)
    vocab = [b"kwyjibo", b"zanzibar", b"quokka", *(b"v%dx" % i for i in range(500))]
    hashes = np.array([T.feature_hashes(w) for w in vocab], np.uint64)
    tokens = [rng.integers(3, len(vocab), 20) for _ in range(4000)]
    toxic = [i < 2000 for i in range(4000)]
    for i in range(25):
        tokens[i][rng.integers(1, 19)] = 0
        tokens[100 + i][5:12] = [7, 8, 9, 1, 10, 11, 12]
    for i in range(200, 206):
        tokens[i][7] = 2
    marks = set(T.label_tokens(tokens, toxic, hashes).tolist())
    assert [int(h[0]) in marks for h in hashes[:3]] == [True, False, False]
    assert not marks & set(hashes[3:, 0].tolist())


def test_chance_is_a_binomial_tail():
    def tail(n, c, p):
        return sum(math.comb(n + c, j) * p ** (n + c - j) * (1 - p) ** j for j in range(c + 1))

    n, c = np.array([5, 9, 9, 40]), np.array([0, 2, 0, 3])
    assert T.chance(n, c, 0.4) == pytest.approx([tail(*x, 0.4) for x in zip(n.tolist(), c.tolist())])
    assert len(T.chance(n[:0], c[:0], 0.4)) == 0


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    scored = T.toxicity(docs, T.fit(docs, labels)).join(labels, "doc_id").where(T.held_out()).select("predicted", "toxic", "spans").collect()
    hit = sum(r.predicted and r.toxic for r in scored)
    # Some labels are wrong: about one toxic document in fourteen holds no toxic word.
    assert hit >= 0.85 * sum(r.toxic for r in scored) and hit >= 0.95 * sum(r.predicted for r in scored)
    assert all(r.spans for r in scored if r.predicted)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    scored = T.toxicity(odd, T.fit(odd, labels)).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert T.fit(odd, labels.limit(0)) is None and {r.score for r in T.toxicity(odd, None).collect()} == {0.0}
    assert T.toxicity(odd.limit(0), T.fit(odd, labels)).count() == 0
    # New columns replace those of their names; a filter keeps all as they are.
    assert scored[0].hits == 7 and len(scored[0].asDict()) == len(odd.columns)
    kept = T.drop_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and [r.score for r in kept.collect()] == [0.5] * odd.count()


def test_sample_does_not_depend_on_the_layout(spark, monkeypatch):
    """The byte limit is filled in the order of a hash of the ids."""
    monkeypatch.setattr(T, "SAMPLE_BYTES", 2000)
    taken = []
    monkeypatch.setattr(T, "train", lambda sample, share: taken.append(sample))
    rows = [(i, f"text {i} " * (i % 9 + 1)) for i in range(120)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    T.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    T.fit(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7), labels.orderBy("toxic"))
    assert taken[0] == taken[1] and 1500 < sum(len(t) for t, _ in taken[0]) <= 2000


def test_scores_against_plain_python(spark):
    """Words marked by their documents, trained and scored on Spark, give what a token-by-token chain gives."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join([f"w{k}" for k in rng.integers(0, 60, 12)] + ["vile"] * (i % 4 == 0) + [f"z{k}" for k in rng.integers(0, 60, 3)])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    model = T.fit(df, labels)
    got = {r.doc_id: r for r in T.toxicity(df, model).collect()}
    for i, text in rows[:80]:
        words = text.encode().split()
        u = np.array([sum(model.weights[int(h) >> (64 - T.FEATURE_BITS)] for h in T.feature_hashes(w)) + model.bias for w in words])
        f, b = [model.start * [1, np.exp(u[0])]], [np.ones(2)]
        for x in u[1:]:
            f.append((f[-1] / f[-1].sum()) @ model.step * [1, np.exp(x)])
        for x in u[:0:-1]:
            b.append(model.step @ (b[-1] / b[-1].sum() * [1, np.exp(x)]))
        p = np.array([(y := s * t)[1] / y.sum() for s, t in zip(f, b[::-1])])
        features = [p.max(), 1 - np.prod(1 - p), np.log1p(p.sum()), np.log1p(len(p))]
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(features @ model.curve[:-1] + model.curve[-1]))), abs=1e-6)
        assert got[i].predicted == (i % 4 == 0)
        if i % 4 == 0:
            at = text.index("vile")
            assert [(s.begin, s.end) for s in got[i].spans] == [(at, at + 4)]
