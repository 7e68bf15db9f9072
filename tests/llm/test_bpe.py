import base64
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vertexlake.llm import bpe
from vertexlake.llm.pretokens import class_table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary() | {"classes": class_table()})


def ids(encoder, texts):
    flat, starts = encoder.encode(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(starts, starts[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="'sstrevemlld  \n\t 　\x00aZé9²½日٣.,!\U0001f600́​", max_size=30)), max_size=6))
def test_like_the_library_on_awkward_texts(encoder, library, texts):
    assert ids(encoder, texts) == [library.encode_ordinary(t) if t else [] for t in texts]


def test_like_the_library_on_long_pretokens(encoder, library):
    rng = random.Random(1)
    texts = ["a" * 50_001, "ab" * 20_000, "." * 9_999, " " * 4_000, "'" * 3_000, "".join(rng.choice("abcdefgh") for _ in range(60_000)), "<|endoftext|> is text", "we'll WE'LL 'sure it's'd"]
    assert ids(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_the_queue_gives_ranks_in_order():
    q, rng = bpe.RankBitmap(), random.Random(2)
    want = sorted({rng.randrange(50_000) for _ in range(3_000)})
    for r in rng.sample(want, len(want)):
        q.add(r)
        q.add(r)
    got = []
    while (r := q.pop()) >= 0:
        got.append(r)
    assert got == want


def test_the_store_may_be_emptied_between_batches(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    monkeypatch.setattr(bpe, "CUT", 5)
    texts = ["one two three", None, "", "four five six", " \n ", "one"]
    for _ in range(3):
        assert ids(encoder, texts) == [library.encode_ordinary(t) if t else [] for t in texts]


def test_every_row_comes_out_once(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "y"), (4, "hello world", None), (4, "hello world", "z")]
    df = spark.createDataFrame(rows, "doc_id int, text string, text_ string")
    got = sorted((r.doc_id, list(r.ids), r.text_ or "") for r in bpe.encode(df).collect())
    assert got == sorted((i, library.encode_ordinary(t) if t else [], x or "") for i, t, x in rows)
    n = {(r.doc_id, r.n_tokens) for r in bpe.count_tokens(df, keep=["doc_id"]).collect()}
    assert n == {(i, len(library.encode_ordinary(t)) if t else 0) for i, t, _ in rows}
    assert bpe.encode(df.limit(0)).count() == 0


def test_ids_decode_to_the_text(encoder, library):
    texts = ["Grüße, 小さな 試料\r\n\r\n", "x\x00y", "\U0001f642"]
    assert [library.decode(i) for i in ids(encoder, texts)] == texts
    assert np.array_equal(encoder.counts(pa.array(texts)), [len(i) for i in ids(encoder, texts)])
