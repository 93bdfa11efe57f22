import itertools
import random
import zlib
from collections import Counter

from tidewater.llm import sharding


def by_scan(sizes, capacity):
    """Best fit without a tree."""
    free, out = [], []
    for s in sizes:
        fit = [(f, b) for b, f in enumerate(free) if f >= s] if s <= capacity else []
        if fit:
            b = min(fit)[1]
        else:
            b = len(free)
            free.append(max(capacity, s))
        out.append(b)
        free[b] -= s
        if s > capacity:
            free[b] = -1
    return out


def runs_of(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def test_runs_equal_a_scan_of_items():
    """Runs of equal sizes through the tree fill the same bins as items one by one without a tree."""
    rng = random.Random(3)
    for most in (12, 997):
        sizes = sorted((rng.randrange(1, most) for _ in range(800)), reverse=True)
        for capacity in (900, 1000, 5000, 10):
            got, opened = sharding.best_fit_decreasing(runs_of(sizes), capacity)
            want = by_scan(sizes, capacity)
            assert [x for size, b, n in got for x in [(size, b)] * n] == list(zip(sizes, want)) and opened == max(want) + 1


def test_pack_finds_the_least_capacity_but_a_step():
    rng = random.Random(4)
    for largest in (50, 4000, 90_000):
        sizes = sorted([rng.randrange(1, 400) for _ in range(600)] + [largest], reverse=True)
        got = sharding.pack(runs_of(sizes), 10)
        load = Counter()
        for size, b, n in got:
            load[b] += size * n
        assert sum(n for *_, n in got) == len(sizes) and set(load) <= set(range(10))
        shared = sum(sizes) - largest if largest > sum(sizes) / 10 else sum(sizes)
        low = max(-(-shared // (9 if shared < sum(sizes) else 10)), sizes[1])
        least = next(c for c in itertools.count(low) if max(by_scan(sizes, c)) < 10)
        assert max(x for b, x in load.items() if x != largest) <= least + max(1, low // 10_000)


def test_every_group_is_packed_by_best_fit(spark, monkeypatch):
    """The shards hold the group sizes that best fit without runs, tree or Spark gives them; groups of a size in parts."""
    monkeypatch.setattr(sharding, "NUMBERED", 50)
    rng = random.Random(5)
    texts = [f"{i:04d}" * rng.choice([1, 1, 1, 7, 30, 99]) for i in range(900)]
    texts += ["copied"] * 400 + texts[:200]
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = Counter()
    for t in texts:
        groups[t] += len(t.encode()) + 16
    sizes = sorted(groups.values(), reverse=True)
    low = -(-sum(sizes) // 40) if sizes[0] * 40 <= sum(sizes) else None
    of = {r.doc_id: r.shard for r in rows}
    got = {}
    for i, t in enumerate(texts):
        got.setdefault(of[i], {})[t] = groups[t]
    capacity = max(sum(g.values()) for g in got.values() if len(g) > 1)
    wants = []
    for c in range(capacity, capacity + 60):
        want = {}
        for size, b in zip(sizes, by_scan(sizes, c)):
            want.setdefault(b, []).append(size)
        wants.append(sorted(map(sorted, want.values())))
    assert low is None and len(got) == 40
    assert sorted(sorted(g.values()) for g in got.values()) in wants


def test_shards(docs):
    rows = sharding.shard(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    slots, shard_of, total = {}, {}, [0] * 40
    for r in rows:
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        slots.setdefault(r.shard, []).append(r.slot)
        assert shard_of.setdefault(text[r.doc_id], r.shard) == r.shard
        total[r.shard] += r.size
    assert len(rows) == len(text) and set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_even_sizes(spark):
    big = spark.range(20_000).selectExpr("id doc_id", "repeat(md5(cast(id as string)), cast(1 + id % 50 as int)) text")
    total = [r[0] for r in sharding.shard(big).groupBy("shard").sum("size").select("sum(size)").collect()]
    assert len(total) == 40 and max(total) < 1.005 * min(total)


def test_odd_rows(odd):
    rows = sharding.shard(odd).collect()
    assert len(rows) == odd.count()
    assert {r.size for r in rows if r.doc_id in (1, 2, 9)} == {16}
    assert len({r.shard for r in rows if r.doc_id in (1, 9)}) == 1 and len({r.shard for r in rows if r.doc_id in (3, 4)}) == 1
    assert sharding.shard(odd.limit(0)).count() == 0
