import corpus_pipeline
from test_decontaminate import brute as contaminated
from test_linededup import brute as line_brute
from test_ngram_join import brute as components
from tokenizers import Tokenizer

import public_tokenizers as P
from tidewater.llm import linededup, toxicity


def test_stages_against_brute_force(spark, sf, tmp_path):
    """Each stage on what its predecessor kept, written and read again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, model_docs = docs.columns, docs
    bench = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            scored = toxicity.toxicity(model_docs, toxicity.fit(model_docs, spark.read.parquet(f"{sf}/labels.parquet")))
            assert {r.doc_id for r in after} == {r.doc_id for r in scored.where("score < 0.7").collect()}
        elif name == "line_dedup":
            want = line_brute([(r.doc_id, r.source, r.text) for r in before.values()], linededup.MIN_SITES)
            assert {r.doc_id: r.text for r in after} == {d: x[2] for d, x in want.items()}
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "ngram_join":
            assert {r.doc_id for r in after} == {d for d, (_, c) in components([(r.doc_id, r.text) for r in before.values()]).items() if c == d}
        elif name == "decontamination":
            ids = list(before)
            bad = {ids[k] for k in contaminated([before[d].text.encode() for d in ids], bench)}
            assert {r.doc_id for r in after} == set(ids) - bad
        else:
            library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
            assert {r.doc_id: r.doc_tokens for r in after} == {d: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in before.items()}


def test_stages_on_odd_rows_and_none(spark, odd, sf):
    """Nulls, empty and long texts, repeated rows and clashing names in every stage; then a table without rows."""
    docs = odd.selectExpr("*", "cast(null as string) source")
    for rows, kept in ((docs, {"toxicity": 11, "line_dedup": 11, "ngram_join": 9, "decontamination": 11}), (docs.limit(0), {})):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            if name == "packing":
                assert {r.doc_id for r in out.collect()} == {r.doc_id for r in rows.collect()}
            else:
                assert out.columns == rows.columns and out.count() == kept.get(name, 0), name
                assert {(r.doc_id, r.n_words) for r in out.collect()} <= {(r.doc_id, r.n_words) for r in rows.collect()}
