import zlib

import public_tokenizers as P
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidewater.llm import common, packing, tokens
from tidewater.llm.common import attach

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD_TEXT = st.text(alphabet="s't3İıŉÄẞx- \n\t\r\x0b\x1c  \u0085aB'1.́é<|endoftext|>ſΣİ", max_size=60)


@settings(max_examples=400, deadline=None)
@given(ODD_TEXT)
def test_counts_equal_the_library(text):
    counter = test_counts_equal_the_library.counter
    assert counter.count([text]) == [len(counter.counts.tokenizer.encode(text, add_special_tokens=False).ids)]


test_counts_equal_the_library.counter = tokens.Counter(BYTE)


@settings(max_examples=400, deadline=None)
@given(ODD_TEXT)
def test_ids_equal_the_library(text):
    encoder = test_ids_equal_the_library.encoder
    want = b"".join(i.to_bytes(4, "little") for i in encoder.ids.tokenizer.encode(text, add_special_tokens=False).ids)
    assert encoder.encode([text]) == [want]


test_ids_equal_the_library.encoder = packing.Encoder(WORD)


def test_counts_of_whole_table(spark, docs):
    library = Tokenizer.from_file(BYTE)
    counts, _ = tokens.count_tokens(docs, BYTE)
    want = sorted((r.doc_id, len(r.text.encode()), len(library.encode(r.text, add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted(map(tuple, counts.collect())) == want


def test_cache_is_used_and_grows(spark, tmp_path):
    a = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None)], "doc_id long, text string")
    counts, new = tokens.count_tokens(a, BYTE)
    assert new.count() == 2 and counts.count() == 3
    path = f"file://{tmp_path}/cache"
    tokens.append(new, path)
    # A stored count is believed; other versions' rows are not.
    other = new.selectExpr("digest", "'other' tokenizer", "99L n_tokens")
    cache = spark.read.parquet(path).selectExpr("digest", "tokenizer", "n_tokens + 100 n_tokens").unionByName(other)
    b = spark.createDataFrame([(1, "one two"), (4, "three")], "doc_id long, text string")
    counts, new = tokens.count_tokens(b, BYTE, cache)
    assert dict((r.doc_id, r.n_tokens) for r in counts.collect()) == {1: 102, 4: 1}
    assert new.count() == 1


def test_a_second_run_encodes_nothing(spark, sf, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/cache"
    first = sorted(map(tuple, tokens.op9_token_counts(spark, sf, path).collect()))
    n = tokens.read_cache(spark, path).count()
    encoded = []
    counted = tokens.count_tokens
    monkeypatch.setattr(tokens, "count_tokens", lambda *a, **k: (out := counted(*a, **k), encoded.append(out[1]))[0])
    assert sorted(map(tuple, tokens.op9_token_counts(spark, sf, path).collect())) == first
    assert encoded == [None] and tokens.read_cache(spark, path).count() == n
    # Other texts are encoded, and only those; rows that two jobs appended count once.
    docs = spark.createDataFrame([(1, "a text that is new"), (2, None), (3, "a text that is new")], "doc_id long, text string").unionByName(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    _, new = counted(docs, BYTE, tokens.read_cache(spark, path))
    assert new.count() == 2 - spark.read.parquet(f"{sf}/documents.parquet").where("text = ''").limit(1).count()
    tokens.append(new, path)
    tokens.append(new, path)
    counts, none = counted(docs, BYTE, tokens.read_cache(spark, path))
    assert none is None and counts.count() == docs.count()


def test_a_hot_digest_is_sent(spark, monkeypatch):
    """A text that a third of the rows share goes by broadcast, the others by shuffle."""
    monkeypatch.setattr(tokens, "attach", lambda rows, by, keys, n, total, limit: attach(rows, by, keys, n, total, 0))
    monkeypatch.setattr(common, "HEAVY", 10)
    rows = [(i, "the same words again" if i % 3 == 0 else f"word {i}") for i in range(300)]
    counts, _ = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), BYTE)
    library = Tokenizer.from_file(BYTE)
    assert sorted((r.doc_id, r.n_tokens) for r in counts.collect()) == [(i, len(library.encode(t).ids)) for i, t in rows]


def test_odd_rows(odd):
    counts, new = tokens.count_tokens(odd, BYTE)
    library = Tokenizer.from_file(BYTE)
    want = sorted(((r.doc_id or -1), len((r.text or "").encode()), len(library.encode(r.text or "").ids)) for r in odd.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in counts.collect()) == want
    assert tokens.count_tokens(odd.limit(0), BYTE)[0].count() == 0


def test_pieces_rebuild_documents(spark, docs):
    library = Tokenizer.from_file(WORD)
    out = packing.pack(docs, WORD, with_ids=True).collect()
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    by = {}
    for r in out:
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
        by.setdefault(r.doc_id, {})[r.start] = bytes(r.ids)
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids + [2]
        assert b"".join(v for _, v in sorted(by[r.doc_id].items())) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_packing_odd_rows(odd):
    out = packing.pack(odd, WORD).collect()
    assert sum(r.length for r in out if r.doc_id == 1) == 1
    twice = [r for r in out if r.doc_id == 5]
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens
    assert packing.pack(odd.limit(0), WORD).count() == 0
