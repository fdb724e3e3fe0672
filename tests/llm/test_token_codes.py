import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspan.llm import token_codes as tc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_query_equals_the_library(spark, sf_dir):
    docs = sorted(pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda d: d["doc_id"])
    want, start = [], 0
    for d, e in zip(docs, plain().encode_batch([d["text"] or "" for d in docs], add_special_tokens=False), strict=True):
        ids = [*e.ids, 0]
        want.append((d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tc.op9_token_codes(spark, sf_dir).orderBy("doc_id").collect()]
    assert got == want


EDGE = ["", " ", "a  b", "a\n\nb ", "\n", "x\n y", "it's we'll  'tis", "a\0b c", "<|endoftext|> x", "naïve café b　c!? ", "Tab\tand\x1c\x1d!x", "日本 語  text", "! !! a!b !'s", "word's. word'll, 'S", "é́ ​ x\r\n y"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(EDGE), st.text(alphabet="ab '.!\n\t1é", max_size=20), st.text(max_size=12)), max_size=5))
def test_encoder_is_exact(texts):
    enc = tc.encoder(VOCABULARY)
    assert [x.tolist() for x in enc(texts)] == [e.ids for e in plain_once().encode_batch(texts, add_special_tokens=False)]


_PLAIN = []


def plain_once():
    if not _PLAIN:
        _PLAIN.append(plain())
    return _PLAIN[0]


@given(st.lists(st.integers(0, 2**31), max_size=1500))
@settings(max_examples=50, deadline=None)
def test_codes_round_trip(ids):
    levels = tc.pack(np.array(ids, np.uint32))
    assert tc.unpack(levels).tolist() == ids
    for i in range(0, len(ids), 97):
        assert tc.token_at(levels, i) == ids[i]


def test_edges_and_random_access(spark, tmp_path):
    rows = [(3, "c"), (1, None), (2, "long " * 30000), (None, "n"), (3, "c"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("start", F.lit(0))
    path = str(tmp_path / "tokens")
    tc.write_tokens(docs, path, VOCABULARY)
    got = tc.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 4]
    assert got[1].n_tokens == 1 and got[2].n_tokens > 30000
    stream = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    places = [0, 3, 20000, len(stream) - 1]
    found = {r.place: r.id for r in tc.fetch_tokens(spark, path, places).collect()}
    assert found == {p: int(stream[p]) for p in places}
    empty = str(tmp_path / "none")
    tc.write_tokens(docs.limit(0), empty, VOCABULARY)
    assert tc.read_tokens(spark, empty).count() == 0


@pytest.mark.parametrize("text", EDGE)
def test_single_texts(text):
    assert tc.encoder(VOCABULARY)([text])[0].tolist() == plain_once().encode(text, add_special_tokens=False).ids
