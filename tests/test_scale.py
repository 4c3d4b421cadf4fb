"""What keeps queries small on large tables: counts made row by row, work done once, batches coded at once."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.functions import codec
from wordloom.operators import feedback, index, rank
from wordloom.operators.index import Index
from wordloom.plans.registry import ORACLE_SQL, QUERIES

TEXTS = ["The cat and the dog, the END", "a b\na c b a", "", None, "ÀÉ 12 ß12 àé", "one"]


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ids", [range(6), [1, 1, 2, None, 4, None]])
@pytest.mark.parametrize("stem", [False, True])
def test_row_by_row(spark, ids, stem):
    docs = spark.createDataFrame(list(zip(ids, TEXTS)), "doc_id long, text string")
    tokens = index.token_rows(docs, stem)
    assert rows(index.doc_terms(docs, stem)) == rows(index.doc_tf(tokens)) == rows(index.flat(index.doc_counts(docs, stem)))
    assert rows(index.doc_postings(docs, stem)) == rows(index.postings(tokens))


@pytest.mark.parametrize("name", ["postings_positions", "position_deltas", "vbyte_round_trip"])
def test_no_shuffle(spark, sf_dir, name):
    assert "Exchange" not in plan(QUERIES[name](spark, sf_dir))


def test_docid_deltas_shuffles_once(spark, sf_dir):
    assert plan(QUERIES["docid_deltas"](spark, sf_dir)).count("Exchange hashpartitioning") == 1


def test_grams_counted_within_terms(spark, sf_dir):
    assert "Expand" not in (p := plan(QUERIES["char_ngrams"](spark, sf_dir))) and p.count("Exchange hashpartitioning") == 2


def test_cosine_moves_pairs_twice(spark, sf_dir):
    """To their term's statistics and back to their document; neither is sorted."""
    ix = Index.build(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit("").alias("title"), F.col("text").alias("body")), keep=True)
    p = plan(rank.cosine(ix, ["the", "that"]))
    assert "ShuffledHashJoin" in p and "SortMergeJoin" not in p and p.count("Exchange hashpartitioning") <= 3
    few = spark.createDataFrame([("q", 1)], "query string, doc_id long")
    asked = spark.createDataFrame([("q", "the")], "query string, term string")
    for df in (feedback.expand(ix.doc_tf, few, ["the"], 5), feedback.expand_batch(ix.doc_tf, few, asked, 5)):
        assert "SortMergeJoin LeftSemi" not in plan(df) and "SortMergeJoin [doc_id" not in plan(df)


@pytest.mark.parametrize("name", ["rank_cosine_saved", "trending_topics_json", "results_html", "last_term_suggest", "zero_hit_rewrite"])
def test_tokens_made_once(spark, sf_dir, name):
    assert "regexp_extract_all" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_codes_of_batches():
    r = random.Random(1)
    numbers = lambda: r.choice([0, 1, 127, 128, 16383, 16384, 2**31, 2**63 - 1, r.randrange(10**6)])
    lists = [None if r.random() < 0.1 else [numbers() for _ in range(r.randrange(4))] for _ in range(2000)]
    coded = codec.encode_rows(pa.array(lists, pa.list_(pa.int64()))[7:])
    assert coded.to_pylist() == [None if x is None else codec.encode(x) for x in lists[7:]]
    assert codec.decode_rows(coded[5:]).to_pylist() == lists[12:]
    odd = [b"\x01", b"\x81\x02", b"\x83", b"", b"\x05\x06"]
    assert codec.decode_rows(pa.array(odd, pa.binary())).to_pylist() == [codec.decode(x) for x in odd]
    with pytest.raises(ValueError):
        codec.encode_rows(pa.array([[1, -1]], pa.list_(pa.int64())))


def test_ngram_distance_is_the_sql_one(spark, tmp_path):
    """ca and abc: 2 apart where what was swapped may be edited again, 3 where not."""
    spark.createDataFrame([(1, "abcdefghijabc abcdefghijabc zebra", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "axbcdefghijca")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, cur = QUERIES["spell_ngram"](spark, str(tmp_path)), con.execute(ORACLE_SQL["spell_ngram"])
    want = [dict(zip([d[0] for d in cur.description], r)) for r in cur.fetchall()]
    assert [r.asDict() for r in got.collect()] == want and want[0]["distance"] == 2
