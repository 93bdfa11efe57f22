import random

from tidewater.llm import common, substring as S


def brute(rows, window=13):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    low = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            low[g] = min(d, low.get(g, d))
    out = {}
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if low[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def cases(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    shared = [[word() for _ in range(rng.choice([12, 13, 14, 60, 200]))] for _ in range(8)]
    rows = []
    for _ in range(60):
        text = []
        for _ in range(rng.randrange(4)):
            text += [word() for _ in range(rng.randrange(30))]
            if rng.random() < 0.6:
                own = rng.choice(shared)
                b = rng.randrange(len(own) // 3 + 1)
                text += own[b : len(own) - rng.randrange(3)]
        rows.append(" ".join(text))
    rows += rng.sample(rows, 10) + ["tick tock " * 40, "tick tock " * 30]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    for seed in range(3):
        rows = cases(seed)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute(rows), seed


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "FILTER_BITS", 6)
    rows = cases(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_colliding_hashes_lose_no_word(spark):
    """With hashes of 9 bits nearly every edge collides; the words at the coordinates settle it."""
    rows = cases(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in S.dedup_substrings(df, hash_bits=9).collect()}
    assert got == brute(rows)


def test_paths_end_at_branching_nodes(spark):
    """Two documents share a passage that goes on differently in others: the node where it forks parts the paths."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, f"{a} {b} x"), (2, f"{a} {c} y"), (3, f"z {a} {b}"), (4, f"w {a} {c}")]
    words = {d: t.split() for d, t in rows}
    met = []
    for d, w in words.items():
        for i in range(len(w) - 12):
            met.append((tuple(w[i : i + 13]), d, i))
    edge = {e: k for k, e in enumerate(dict.fromkeys(e for e, _, _ in met))}
    first = {}
    for e, d, i in met:
        first.setdefault(e, (d, i))
    several = {e for e in edge if len({d for x, d, _ in met if x == e}) > 1}
    df = spark.createDataFrame([(edge[e], d, i, *first[e]) for e, d, i in met if e in several], "edge long, doc_id long, start long, source long, source_start long")
    paths = sorted((r.doc_id, r.start, r.edges, r.source, r.source_start) for r in S._compacted(df, 13, S.Scratch(spark, "test")).collect())
    # The passage a has 18 edges; the edges after them branch to b or c.
    assert paths == [(2, 0, 18, 1, 0), (3, 1, 18, 1, 0), (3, 19, 30, 1, 18), (4, 1, 18, 1, 0), (4, 19, 30, 2, 18)]


def test_window_hashes_by_doubling():
    h = S.np.random.default_rng(2).integers(0, 1 << 63, 50).astype(S.np.uint64)
    for n in (1, 2, 5, 12, 13, 50):
        want = []
        for i in range(len(h) - n + 1):
            x = 0
            for w in h[i : i + n].tolist():
                x = (x * int(common._BASE) + w) % (1 << 64)
            want.append(x)
        assert (S.window_hashes(h, n) == S.mix(S.np.array(want, S.np.uint64) + S.np.uint64(n))).all()


def test_spans_name_their_source(spark):
    rows = cases(3)
    words = {d: t.split() for d, t in rows}
    spans = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert spans
    for r in spans:
        n = r.edges + 12
        assert r.source < r.doc_id and words[r.doc_id][r.start : r.start + n] == words[r.source][r.source_start : r.source_start + n]


def test_odd_rows(odd):
    got = [(r.doc_id, r.n_words, r.n_removed) for r in S.dedup_substrings(odd).collect()]
    assert len(got) == odd.count()
    assert got.count((5, 30_000, 0)) == 2 and (6, 30_001, 30_000) in got and (1, 0, 0) in got and (None, 5, 0) in got
    assert S.dedup_substrings(odd.limit(0)).count() == 0
