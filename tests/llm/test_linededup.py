import random

from pyspark.sql import functions as F

from tidewater.llm import common, linededup as L


def brute(rows, least):
    sites, first = {}, {}
    for d, s, t in rows:
        for i, x in enumerate((t or "").split("\n") if t is not None else []):
            x = x.strip(L.SPACE)
            if x:
                sites.setdefault(x, set()).add(s or "")
                first[x] = min(first.get(x, (d, i)), (d, i))
    out = {}
    for d, _, t in rows:
        lines = t.split("\n") if t is not None else []
        keep = [x for i, x in enumerate(lines) if not (k := x.strip(L.SPACE)) or len(sites[k]) < least or first[k] == (d, i)]
        out[d] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    common = [f"line {i} of many" for i in range(30)] + ["", "  ", " padded\t"]
    rows = []
    for d in range(400):
        n = rng.randrange(6)
        rows.append((d, rng.choice([None, *[f"s{k}" for k in range(16)]]), None if d % 50 == 3 else "\n".join(rng.choices(common[: 3 + d % 31], k=n) + [f"own {d}"] * (d % 3))))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for least in (2, 9, 10, 14):
        got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in L.dedup_lines(df, least).collect()}
        assert got == brute(rows, least), least


def test_beyond_the_lists(spark, monkeypatch):
    """With lists too long to send: hot lines by broadcast, the others by shuffle."""
    monkeypatch.setattr(L, "LISTED", 0)
    monkeypatch.setattr(common, "HEAVY", 8)
    rows = [(d, f"s{d % 12}", "\n".join(["hot"] * (d % 3 == 0) + [f"line {d % 40}", f"own {d}"])) for d in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in L.dedup_lines(df, 3).collect()}
    assert got == brute(rows, 3)


def test_odd_rows(spark, odd):
    df = odd.selectExpr("*", "cast(null as string) source")
    got = L.dedup_lines(df, 2).collect()
    assert len(got) == odd.count() and all(r.n_removed == 0 for r in got)
    assert {(r.n_lines, r.kept) for r in got if r.doc_id in (1, 9)} == {(0, "")}
    assert L.dedup_lines(df.limit(0)).count() == 0
    kept = L.without_boilerplate(df.withColumn("source", F.expr("cast(doc_id as string)")).withColumn("n_chars", F.lit(1)), 2)
    assert kept.columns == [*df.columns, "n_chars"] and kept.where("gone = 'x' and gone_id <=> doc_id").count() == odd.count()
    assert L.without_boilerplate(df.limit(0)).count() == 0
