import random

from tidewater.llm import decontaminate as D


def brute(docs, items, window=10):
    found = {}
    for i, t in items:
        w = D.words(t)
        n = min(window, len(w))
        if not n:
            continue
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, text in enumerate(docs):
            dw = D.words(text)
            for k in range(len(dw) - n + 1):
                if tuple(dw[k : k + n]) in grams:
                    hit, own = found.setdefault(d, (set(), set()))
                    hit.update(range(k, k + n))
                    own.add(str(i))
    return found


def longest(doc, items, window=10):
    """(words, first, item) of the longest run of at least a window that an item and the document share."""
    best, dw = [], D.words(doc)
    for i, t in items:
        w = D.words(t)
        for a in range(len(dw)):
            for b in range(len(w)):
                n = 0
                while a + n < len(dw) and b + n < len(w) and dw[a + n] == w[b + n]:
                    n += 1
                if n and n >= min(window, len(w)):
                    best.append((-n, a, str(i)))
    return (-min(best)[0], *min(best)[1:]) if best else None


def cases(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}".encode() for i in range(6)]
    text = lambda n: b" ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.choice([0, 2, 5, 12, 30]))) for i in range(8)]
    docs = [text(rng.choice([0, 3, 40, 200])) for _ in range(12)] + [text(5) + b" zzz " + items[k][1] + b" end" for k in range(8)]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    for seed, block in ((1, 1 << 20), (2, 60)):
        monkeypatch.setattr(D, "BLOCK_BYTES", block)
        docs, items = cases(seed)
        df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(docs)], "doc_id long, text string")
        bench = spark.createDataFrame([(i, t.decode()) for i, t in items], "item_id long, text string")
        want = brute(docs, items)
        for r in D.contamination(df, bench).collect():
            hit, own = want.get(r.doc_id, (set(), set()))
            assert r.items == sorted(own)
            assert {k for x in r.hits for k in range(x.first, x.first + x.words)} == hit
            assert (tuple(r.longest) if r.longest else None) == longest(docs[r.doc_id], items)
        assert D.decontaminate(df, bench).count() == len(docs) - len(want)


def test_longest_matches(spark):
    words = [f"q{i}" for i in range(40)]
    df = spark.createDataFrame([(1, "x y " + " ".join(words[3:30]) + " z")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    best = max(D.longest_matches(df, bench).collect(), key=lambda r: r.match_words)
    assert (best.item_id, best.item_offset, best.match_words, best.doc_id, best.doc_offset) == ("7", 3, 27, 1, 2)


def test_odd_rows(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(odd, none).count() == odd.count()
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "A"), (3, "a")], "item_id long, text string")
    hit = D.contamination(odd, bench).where("size(hits) > 0").collect()
    assert sorted(r.doc_id for r in hit) == [3, 4] and hit[0]["items"] == ["3"]
    assert D.contamination(odd.limit(0), bench).count() == 0
    assert hit[0].n_words == 1 and hit[0].longest == (1, 0, "3") and hit[0].gone == "x"
    assert D.decontaminate(odd, bench).columns == odd.columns and D.decontaminate(odd.limit(0), bench).count() == 0
    assert sorted((r.n_words, r.score) for r in D.decontaminate(odd, bench).collect()) == sorted((r.n_words, r.score) for r in odd.where("doc_id is null or doc_id not in (3, 4)").collect())
