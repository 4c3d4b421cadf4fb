"""Byte-level BPE against the tiktoken library, and the round trip."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.llm import byte_bpe, queries

BPE = byte_bpe.ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
PEER = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})


def ids(text):
    return np.frombuffer(BPE.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["  ", "\n", "\t", " ", "a", "the", "é", "😀", "1", "23", "'s", "!!", "\x1c", "漢字", "\r\n", "ing"]), max_size=25).map("".join)))
def test_equals_peer(text):
    assert ids(text) == PEER.encode_ordinary(text)
    assert BPE.decode(BPE.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 5000, " " * 3000, "é" * 3000, "abcabd" * 3000, "word " * 9000])
def test_long(text):
    assert ids(text) == PEER.encode_ordinary(text)


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op7_byte_bpe(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = PEER.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_edges(spark):
    schema = "doc_id long, text string, ids string, decoded int"
    df = spark.createDataFrame([(1, None, "x", 1), (1, None, "x", 1), (None, "", "y", 2), (3, "hi there " * 40000, None, None)], schema)
    out = byte_bpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decode=True).collect()
    assert [len(r.ids) for r in out][:3] == [0, 0, 0] and bytes(out[3].decoded).decode() == "hi there " * 40000
    assert byte_bpe.encode_documents(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    again = byte_bpe.decode_documents(byte_bpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert [bytes(r.decoded) for r in again.collect()][0] == b""
