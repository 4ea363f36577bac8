"""The merge-type SentencePiece codec against the sentencepiece library."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kpiforge.llm import pieces as pc
from tests.llm.fixtures import documents, no_documents, odd_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "ab the ▁ \n\t\x00é漢🙂ßinÆ<0x41>" + "".join(map(chr, range(0x300, 0x320)))


def library_ids(own, text):
    return np.array(own.library.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=LETTERS, max_size=60), max_size=5))
def test_codec_equals_library(texts):
    own = pc.pieces(MODEL)
    ids = own.encode(texts)
    assert ids == [library_ids(own, t) for t in texts]
    assert [own.decode(i) for i in ids] == [own.library.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]


def test_long_cuts_and_heap_equal_matrix():
    own = pc.pieces(MODEL)
    texts = ["a" * 5000, " " * 3000, "the" * 4000, "x\n" * 2000, "漢字" * 500]
    assert own.encode(texts) == [library_ids(own, t) for t in texts]
    cuts = [c for c in {"▁" + "".join(random.Random(k).choices("theinrato", k=k % 20 + 1)) for k in range(500)}]
    assert own.by_matrix(cuts) == [own.by_heap(c) for c in cuts]


def test_decoding_of_any_ids_equals_library():
    own, r = pc.pieces(MODEL), random.Random(5)
    for _ in range(2000):
        ids = [r.choice([0, 1, 2, 3 + r.randrange(256), r.randrange(259, 32000), 29871]) for _ in range(r.randint(0, 9))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == own.library.decode(ids), ids


def test_query_digests(spark, sf_small):
    own = pc.pieces(MODEL)
    rows = {r.doc_id: r for r in pc.op12_sentencepiece_codec(spark, sf_small).collect()}
    given_ = documents(spark, sf_small).collect()
    assert len(rows) == len(given_)
    for d in given_:
        ids = own.library.encode(d.text or "", add_bos=True, add_eos=True)
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.library.decode(ids).encode()).hexdigest()


def test_odd_documents(spark):
    df = odd_documents(spark)
    out = pc.piece_encoding(df, MODEL, out="p", whole=True)
    assert out.columns == [*df.columns, "p"]
    own = pc.pieces(MODEL)
    rows = out.collect()
    assert len(rows) == 13
    for r in rows:
        assert bytes(r.p.ids) == library_ids(own, r.text or "")
    assert pc.piece_encoding(no_documents(spark), MODEL).count() == 0


def test_a_difference_from_the_library_ends_the_work():
    own = pc.pieces(MODEL)
    own.confirm({"▁the": own.encode(["the"])[0][4:-4]})
    with pytest.raises(ValueError, match="the"):
        own.confirm({"▁the": own.encode(["them"])[0][4:-4]})
