"""Packing: the ids against the tokenizers library, and the layout of pieces and sequences."""

import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wordloom.llm import packing, queries

PATH = P.path("word_bpe_49k.json")
FULL = Tokenizer.from_file(PATH)
FULL.encode_special_tokens = True
OWN = packing.WordBPE(PATH)


def want(text):
    return FULL.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["  ", "\n", "\t", " ", "a", "The", "É", "é", "́", "ΑΣ", "İ", "1", "23", "'s", "'LL", "!!'", "\x1c", "漢字", "　", "<|endoftext|>"]), max_size=25).map("".join)))
def test_equals_library(text):
    assert np.frombuffer(OWN.encode([text])[0], "<u4").tolist() == want(text)


def test_other_files(tmp_path):
    """A file of another normaliser or splitter goes through the library, with its own ids; a limit of its own doesn't cut."""
    told = json.load(open(PATH))
    told["normalizer"] = {"type": "NFC"}
    told["truncation"] = {"direction": "Right", "max_length": 2, "strategy": "LongestFirst", "stride": 0}
    (path := tmp_path / "other.json").write_text(json.dumps(told))
    full = Tokenizer.from_file(str(path))
    full.no_truncation()
    full.encode_special_tokens = True
    text = "The Quick  brown\tFox, ÉTÉ 42!"
    got = np.frombuffer(packing.WordBPE(str(path)).encode([text])[0], "<u4").tolist()
    assert got == full.encode(text, add_special_tokens=False).ids != want(text)


def test_held_words():
    """Long words are encoded but not held, and what is held stays within its bound."""
    own = packing.WordBPE(PATH)
    texts = ["漢字仮名" * 5000 + str(i) for i in range(20)] + ["x" * 65, "short"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [want(t) for t in texts]
    assert set(own.words) == {"short"} and own.held < 300


def test_every_character():
    texts = [f"a{c} {c}b {c}" for c in map(chr, range(0x3000)) if not 0xD800 <= ord(c) < 0xE000]
    for t, raw in zip(texts, OWN.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == want(t), repr(t)


def layout(rows, texts, size):
    """Each document is whole, each sequence gapless; the share of padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        ids = want(texts[doc]) + [1]
        at = 0
        for r in pieces:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    pad = total = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        n = 0
        for r in pieces:
            assert r.offset == n and r.length > 0
            n += r.length
        assert n <= size
        pad += 0 if n & (n - 1) == 0 else size - n
        total += n
    return pad / total


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert layout(queries.op1_packing(spark, sf_dir).collect(), texts, 2048) < 0.01


def test_rounds_and_edges(spark):
    texts = {i: None if i == 0 else "" if i == 1 else "word and more " * (i * 7 % 60) for i in range(200)} | {900: "long one " * 30000}
    df = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, ids int").repartition(9)
    from pyspark.sql import functions as F

    out = packing.pack(df, PATH, 1, size=64, open_windows=3, fan_in=2).withColumn("ids_crc32", F.crc32("ids"))
    assert layout(out.collect(), texts, 64) < 0.05
    assert packing.pack(df.limit(0), PATH, 1).count() == 0
    twice = packing.pack(df.where("doc_id = 5").union(df.where("doc_id = 5")), PATH, 1).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens
