import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import lm

TEXTS = [(i, t) for i, t in enumerate(["The cat sat.", "the cat", "The hat sat  on\nthe mat", "", "é è ê", "cat hat mat " * 9, "zebra", "on the mat sat the cat"] * 3)]


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def brute(rows):
    """Recursive context-tree weighting over dicts, and the word base."""
    tree = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    words, train = Counter(), [r for r in rows if not lm.held_out(r[0])]

    def decisions(text):
        data = b"\x00" * lm.DEPTH + text.encode().lower() + lm.END
        for t in range(lm.DEPTH, len(data)):
            context = data[t - lm.DEPTH : t][::-1]
            for j in range(8):
                yield context, 1 << j | data[t] >> 8 - j, data[t] >> 7 - j & 1

    for _, text in train:
        words.update([*(text or "").encode().lower().split(), b""])
        for context, node, bit in decisions(text or ""):
            for d in range(lm.DEPTH + 1):
                tree[context[:d], node][bit] += 1
                if d:
                    children[context[: d - 1], node].add(context[:d])
    memo = {}

    def weighted(context, node):
        if (context, node) not in memo:
            own = log_kt(*tree[context, node])
            if len(context) < lm.DEPTH:
                below = sum(weighted(c, node) for c in children[context, node])
                own = np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)
            memo[context, node] = own
        return memo[context, node]

    def probability(context, node, bit, d=0):
        if (context[:d], node) not in tree:
            return None
        counts = tree[context[:d], node]
        own = (counts[bit] + 0.5) / (sum(counts) + 1)
        below = probability(context, node, bit, d + 1) if d < lm.DEPTH else None
        if below is None:
            return own
        stop = math.exp(math.log(0.5) + log_kt(*counts) - weighted(context[:d], node))
        return stop * own + (1 - stop) * below

    n, out = sum(words.values()), []
    for doc_id, text in rows:
        tokens = [*(text or "").encode().lower().split(), b""]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (len(words) + 1))) for w in tokens)
        own = sum(math.log10(p if (p := probability(*x)) is not None else 0.5) for x in decisions(text or ""))
        out.append((doc_id, len(tokens), sum(w in words for w in tokens), n, pytest.approx(base), pytest.approx(own, rel=1e-8)))
    return out


@pytest.mark.parametrize("model, head", [(10**6, 10**6), (0, 4)])
def test_against_brute_force(spark, monkeypatch, model, head):
    monkeypatch.setattr(lm, "MODEL_ROWS", model)
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    rows = [*TEXTS, (99, None)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == brute(rows)
    assert {r.held_out for r in got} == {True, False}


def test_both_ways_give_the_same_digits(spark, docs, monkeypatch):
    """A gram table that is sent, and one that is joined; chunks of a few grams and of many."""
    sent = sorted((r.doc_id, r.score) for r in lm.score(docs).collect())
    monkeypatch.setattr(lm, "MODEL_ROWS", 0)
    monkeypatch.setattr(lm, "BATCH", 1 << 14)
    assert sorted((r.doc_id, r.score) for r in lm.score(docs).collect()) == sent


def test_chunks_hold_whole_groups_and_their_nodes():
    """Groups of four context bytes are never cut, each chunk has its nodes, and no more than a group is held over."""
    rng = np.random.default_rng(1)
    c = np.repeat(np.sort(rng.integers(0, 40, 9)), 300)
    key = np.sort(np.unique((rng.integers(0, 3, len(c)) << 32 | c << 8 | rng.integers(0, 256, len(c))).astype(np.uint64)))
    key = key[np.lexsort((key, key >> np.uint64(8) & np.uint64(0xFFFFFFFF), key >> np.uint64(8) & np.uint64(0xFFFFFF)))]
    batch = lambda k, node: lm.pa.RecordBatch.from_pydict({"key": k.view(np.int64), "n": np.ones(len(k), np.int64), "node": lm.pa.array([node] * len(k), lm.pa.int64()),
                                                           **{x: np.ones(len(k)) for x in lm.Nodes.columns}})
    stream = []
    for x in np.unique(key >> np.uint64(8) & np.uint64(0xFFFFFF)):
        stream.append(batch(np.array([int(x) << 8 | 1], np.uint64), 1))
        own = key[key >> np.uint64(8) & np.uint64(0xFFFFFF) == x]
        stream += [batch(own[i : i + 70], None) for i in range(0, len(own), 70)]
    got = list(lm._chunks(iter(stream), 100))
    assert (np.concatenate([k for _, k, _ in got]) == key).all() and len(got) > 5
    groups = [set((k >> np.uint64(8)).tolist()) for _, k, _ in got]
    assert sum(map(len, groups)) == len(set().union(*groups))
    assert all(set((k >> np.uint64(8) & np.uint64(0xFFFFFF)).tolist()) <= set((t.keys >> 8).tolist()) for t, k, _ in got)


def test_lookup():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    own = lm.Lookup(keys[::2], np.arange(len(keys[::2])))
    values, found = own.get(keys)
    assert found[::2].all() and not found[1::2].any() and (values[::2] == np.arange(len(keys[::2]))).all()
    assert not lm.Lookup(keys[:0], np.arange(0)).get(keys)[1].any()


def test_held_out_beats_the_base(docs):
    held = lm.score(docs.where("lang = 'en'")).where("held_out").agg({"bits_per_byte": "avg"}).first()[0]
    assert held < 3


def test_odd_rows(odd):
    got = lm.score(odd).collect()
    assert len(got) == odd.count() and len({(r.doc_id, r.score) for r in got if r.doc_id == 5}) == 1
    assert lm.score(odd.limit(0)).count() == 0
