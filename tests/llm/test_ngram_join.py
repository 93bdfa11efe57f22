import random

import numpy as np

from tidewater.llm import ngram_join as N


def brute(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def near_copies(seed):
    """Chains and stars of near copies, passages that many share, short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(25)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own += passage
            rows.append(" ".join(own))
            if rng.random() < 0.4:
                base = own[:]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    for seed in range(4):
        rows = near_copies(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute(rows), seed


def test_long_lists_and_hubs(spark, monkeypatch):
    """Lists cut into parts of two members, hubs of three pairs: nothing is lost."""
    monkeypatch.setattr(N, "HUB", 3)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(160):
        own = list(base)
        own[rng.randrange(60)] = f"x{i}"
        rows.append(" ".join(own + ["tail"] * (i % 3)))
    for i in range(40):
        rows.append(" ".join(base[:14] + [f"q{i}_{k}" for k in range(rng.randrange(8, 60))]))
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (1, 13):
        prefixes = N._prefixes
        monkeypatch.setattr(N, "_prefixes", lambda *a, b=bits, p=prefixes: p(*a).withColumn("parts", N.F.greatest(N.F.col("parts"), N.F.lit(40 if b == 1 else 1))))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.link_documents(df).collect()}
        monkeypatch.setattr(N, "_prefixes", prefixes)
        assert got == brute(rows), bits


def test_fragments_are_cuts_of_the_order():
    ends = [int(e) for e in N.fragment_ends({0: 9, 3: 500, 5: 100})]
    # The others begin at weight 3; half of their 600 n-grams are three fifths of that weight's.
    assert ends[0] == 1 << 56 and ends[1] >> 56 == 3 and round((ends[1] & (1 << 56) - 1) / (1 << 56), 3) == 0.6
    assert len(N.fragment_ends({})) == N.FRAGMENTS - 1 and int(N.fragment_ends({3: 5, 7: 100})[1]) >> 56 == 7


def test_keep_one(spark):
    rows = near_copies(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in N.keep_one(df).collect()) == sorted({c for _, c in brute(rows).values()})


def test_odd_rows(odd):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in N.link_documents(odd).collect())
    assert len(got) == odd.count()
    by = {g[0]: g for g in got}
    assert by[1] == (1, 0, 1) and by[2] == (2, 0, 2) and by[7] == (7, 0, 7) and by[-1] == (-1, 1, None)
    assert by[3] == (3, 1, 3) and by[4] == (4, 1, 3) and by[6][2] == 5
    assert N.link_documents(odd.limit(0)).count() == 0


def test_bitmaps_keep_every_similar_pair(spark):
    rng = random.Random(5)
    rows, similar, far = [], set(), set()
    for i in range(400):
        n = rng.choice([1, 2, 15, 31, 33, 64, 65, 120, 700])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), rng.randrange(n + 1) if i % 2 else n - n // 10)) | {rng.getrandbits(64) for _ in range(rng.choice([0, n // 10, n // 8, n]))}
        if b:
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            rows.append((i, len(a), len(b), N.bitmap(x).tolist(), N.bitmap(y).tolist()))
            similar |= {i} if 100 * len(a & b) >= 80 * len(a | b) else set()
            far |= {i} if 100 * len(a & b) < 40 * len(a | b) and n > 30 else set()
    df = spark.createDataFrame(rows, "i long, na long, nb long, ga array<long>, gb array<long>")
    kept = {r.i for r in df.where(N._near_bits(*map(N.F.col, ("na", "nb", "ga", "gb")))).collect()}
    assert len(similar) > 50 and similar <= kept
    assert len(far) > 50 and not far & kept
    assert any(len(r[3]) != len(r[4]) for r in rows if r[0] in similar)


def test_far_candidates_move_no_ngrams(spark, monkeypatch):
    """Documents that share a passage only are candidates, but their n-grams stay where they are, in both rounds."""
    rng = random.Random(7)
    rows = []
    for g in range(8):
        passage = [f"p{g}_{k}" for k in range(30)]
        rows += [" ".join(passage + [f"o{g}_{i}_{k}" for k in range(70)]) for i in range(7)]
    for g in range(3):
        base = [f"n{g}_{k}" for k in range(100)]
        rows += [" ".join(base), " ".join(base[:99] + ["end"])]
    rng.shuffle(rows)
    rows, made, keep = list(enumerate(rows)), [], N.Scratch.keep

    def spy(self, df, name="t"):
        out = keep(self, df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(N.Scratch, "keep", spy)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert dict(made)["star"] > 8
    assert [n for name, n in made if name == "segments"] == [6]
    assert [n for name, n in made if name == "cross"] == [0]
