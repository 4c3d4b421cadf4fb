"""The pipeline stage by stage against brute force, and on edge rows."""

import importlib.util
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402


def peer(name):
    spec = importlib.util.spec_from_file_location(name, Path(__file__).with_name(f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


NEAR, PASSAGES, SECRETS = peer("test_simhash_dedup"), peer("test_substring_dedup"), peer("test_secret_scan")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect())
        if name != "packing":
            assert docs.columns == COLUMNS
    raw, ruled, single, deduped, clean, packed = seen
    assert {r.doc_id for r in ruled} < {r.doc_id for r in raw} and len(ruled) > 0.7 * len(raw)
    classes = NEAR.brute([(r.doc_id, r.text) for r in ruled])
    assert {r.doc_id for r in single} == set(classes.values())
    want = PASSAGES.brute([(r.doc_id, r.text) for r in single])
    assert {r.doc_id: r.text for r in deduped} == {d: t for (d, _), t in want.items()}
    for r in clean:
        assert SECRETS.base(r.text) == "" and r.n_chars == len(r.text)
    texts = {r.doc_id: r.text for r in deduped}
    assert all(r.text == texts[r.doc_id] for r in clean if not SECRETS.base(texts[r.doc_id]))
    tokens = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        pieces.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert pieces == {r.doc_id: tokens.encode(r.text, add_special_tokens=False).ids + [1] for r in clean}
    ends = Counter()
    for r in packed:
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    assert max(ends.values()) <= 2048


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_edges(spark, tmp_path):
    text = "a first sentence of plain words, then a second one. And a third with password=abcdefgh12 in it!"
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, None, None, None), (None, text + " more", None, "s", 1), (3, "", "en", None, 0), (4, "one two three four. " * 3 + "five six seven eight nine ten eleven", "en", "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs, some in ((df, True), (df.limit(0), False)):
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{some}-{name}"
            stage(spark, docs, "").write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path) if name != "packing" else spark.read.parquet(path)
            if some and name == "quality_rules":
                assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "1", "None"]
            if some and name == "simhash_dedup":
                assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "None"]
        assert (docs.count() > 0) == some
