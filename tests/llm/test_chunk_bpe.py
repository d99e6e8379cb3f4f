import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import DOC_SCHEMA
from veracity.llm import chunk_bpe as C
from veracity.llm.queries import op12_chunk_bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(C.vocabulary())


@pytest.fixture(scope="module")
def words():
    return C.Words(C.vocabulary())


def plain(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


ODD = ["<|endoftext|>", "<|startoftext|> x", "it's", "'re", "é", " ́b", "Å", " ", " ", "\t", "\r\n", "\n\n", "  ", "İ", "ΑΣ", "각",
       "漢字", "12a3", "\x00", "🙂", "‍", "ﬁ", "don't'll", "\x85", " "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=6), st.sampled_from([" ", "\n", "word", "The"])), max_size=20))
def test_words_are_encoded_as_in_the_text(library, words, parts):
    text = "".join(parts)
    assert words.unpack(words.ids_of([text])[0]).tolist() == library.encode(text, add_special_tokens=False).ids


def prose(rng, n):
    return "".join(rng.choice(["the ", "Quick ", "brown-fox ", "jumps.\n", "don't ", "élan ", "漢字", "42 ", "<|endoftext|>", "a"]) for _ in range(n))


def test_cuts_follow_the_content():
    rng = random.Random(1)
    shared = prose(rng, 3000).encode()
    a, b = b"x" * 777 + shared, prose(rng, 500).encode() + shared
    chunks = [{d[s:e] for s, e in zip([0, *c], c)} for d, c in ((a, C.cuts(a)), (b, C.cuts(b)))]
    assert sum(map(len, chunks[0] & chunks[1])) > 0.6 * len(shared)
    for d in (a, b, b"", "é".encode() * 50_000, b"a" * 100_000, bytes(range(32, 127)) * 300):
        ends = C.cuts(d)
        assert b"".join(d[s:e] for s, e in zip([0, *ends], ends)) == d
        assert all(e - s <= C.MAX_CHUNK + 3 for s, e in zip([0, *ends], ends))
        [d[s:e].decode() for s, e in zip([0, *ends], ends)]  # no cut inside a character


def test_cuts_do_not_depend_on_slices(monkeypatch):
    data = prose(random.Random(2), 20_000).encode()
    want = C.cuts(data)
    monkeypatch.setattr(C, "_SLICE", 1000)
    assert C.cuts(data) == want and len(want) > 20


def test_joins_are_repaired_until_they_agree(words):
    """Pieces cover the text, and a chunk gives words up as long as the ids differ at its edge."""
    rng = random.Random(3)
    repair = C.Repair(words)
    for _ in range(50):
        text = prose(rng, 200)
        at = sorted(rng.sample(range(1, len(text)), 6))
        bounds = [(a, b, rng.random() < 0.6) for a, b in zip([0, *at], [*at, len(text)])]
        parts = repair.pieces(text, bounds)
        assert "".join(text[a:b] for a, b, _ in parts) == text
        joined = b"".join(words.whole(text[a:b]) for a, b, _ in parts)
        assert joined == words.whole(text)
        assert all(k is None or bounds[k][0] <= a < b <= bounds[k][1] for a, b, k in parts)
    stubborn = C.Repair(words)
    stubborn.agree = lambda left, right: len(left) > 0 and right.startswith(" w4")  # disagrees before the fifth word
    text = "".join(f" w{i}" for i in range(10))
    assert stubborn.pieces(text, [(0, 3, False), (3, len(text), True)]) == [(0, 12, None), (12, len(text), 1)]


def test_documents_of_shared_passages(spark, library):
    rng = random.Random(4)
    passage = prose(rng, 2500)
    texts = [prose(rng, rng.randint(0, 40)) + (passage if i % 3 else "") + prose(rng, rng.randint(0, 900)) for i in range(40)]
    texts += [passage] * 30 + ["x" * 30_000 + passage, "no blanks" * 9000, passage.replace(" ", " ")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in C.encode(df).collect()}
    assert got == {i: plain(library, t) for i, t in enumerate(texts)}


def test_odd_rows(spark, library, odd_docs, no_docs):
    got = sorted((tuple(r) for r in C.encode(odd_docs).collect()), key=repr)
    assert got == sorted(((r["doc_id"], *plain(library, r["text"])) for r in odd_docs.collect()), key=repr)
    assert C.encode(no_docs).collect() == []
    assert C.encode(spark.createDataFrame([], DOC_SCHEMA)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_registered_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r[0]: tuple(r[1:]) for r in op12_chunk_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) and got == {r["doc_id"]: plain(library, r["text"]) for r in rows}
