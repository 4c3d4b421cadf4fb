"""Secret scans: the base spans against Python's re, the models on samples, redaction and edges."""

import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from wordloom.llm import queries, secret_scan

KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api")).replace("[aA][pP][iI]", "[aA][pP][iI]_?[kK][eE][yY]")
ASSIGN = re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op10_secret_scan(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r.spans.split(",")) | {""}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))


def test_edges(spark):
    texts = [None, "", "token: token: abcdefghij", "é😀 API_KEY = 'abc12345' x secret=short AKIAAKIA" + "B" * 16, "AKIA" + "0" * 11, "f" * 31, "g" + "0f" * 40 + "x", "password=" + "9a" * 20, "Passwd=\"" + "k" * 90000, "my ghp_x8Kd92LmQpZ7rT4vBn1W and user_name_field_12 in src/main/java/com/v2/App " * 3]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, base int")
    model = secret_scan.train(secret_scan.identifiers(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    found = secret_scan.find(df, model)
    rows = found.select("doc_id", secret_scan.written(F.col("base")).alias("b"), secret_scan.written(F.col("spans")).alias("s")).collect()
    assert len(rows) == 11 and all(r.b == base(texts[r.doc_id]) for r in rows)
    assert {r.doc_id: r.s for r in rows}[9].count("markov") == 3
    clean = {r.doc_id: r.text for r in secret_scan.redact(found).collect()}
    assert clean[0] is None and clean[1] == "" and clean[2] == texts[2] and clean[6] == "g[REDACTED]x" and clean[7] == "[REDACTED]"
    assert "ghp_" not in clean[9] and "user_name_field_12 in src/main" in clean[9]
    assert secret_scan.find(df.limit(0), model).count() == 0
    assert secret_scan.train(secret_scan.identifiers(df.limit(0)))["threshold"] >= 2


def test_letters_only(spark):
    rng = random.Random(3)
    keys = ["".join(rng.choice(string.ascii_letters) for _ in range(20)) for _ in range(200)]
    plain = ["-" * 40, "=" * 20 + " Title " + "-" * 20, "a" + "-" * 30, "|" + "----|" * 9, "/" * 20 + "x", "4111111111111111", "src/main/java/com/app/Main", "Donaudampfschifffahrtsgesellschaft", "THIS_IS_A_CONSTANT_NAME"]
    model = secret_scan.train(secret_scan.identifiers(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    df = spark.createDataFrame([(f"see {x} here",) for x in keys + plain], "text string")
    got = {r.text: r.s for r in secret_scan.find(df, model).select("text", secret_scan.written(F.col("spans")).alias("s")).collect()}
    assert sum(got[f"see {k} here"] == "markov:4:24" for k in keys) > 180
    assert not any(got[f"see {x} here"] for x in plain)


def test_whole_runs(spark):
    """However long a key is, nothing of it stays behind, and none takes more than linear time."""
    rng = random.Random(8)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (16, 255, 256, 257, 268, 272, 522, 100_000)]
    odd = ["-" * 200_000, "a-" * 100_000, "/" * 100_000 + "x", "ab" * 100_000]
    model = secret_scan.train(secret_scan.identifiers(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    df = spark.createDataFrame([(i, f"the key: {k}, ends") for i, k in enumerate(keys)] + [(100 + i, x) for i, x in enumerate(odd)], "__run int, text string")
    got = {r["__run"]: r.text for r in secret_scan.redact(secret_scan.find(df, model)).collect()}
    assert all(got[i] == "the key: [REDACTED], ends" for i in range(len(keys)))
    assert got[100] == odd[0] and len(got) == len(keys) + len(odd)


RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}|(?:[A-Za-z0-9]|[+/_=-](?![+/_=-]{2})){16,}")


def test_markov_spans(spark):
    """The models' spans against plain Python over every document, hits and misses."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secret_scan.train(secret_scan.identifiers(docs))
    rng = random.Random(1)
    docs = docs.select("text").union(spark.createDataFrame([(" ".join(["lead", "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)), "trail_of_words_12"]),) for n in range(14, 60)], "text string"))
    ratio = [float(f"{x:.6g}") for x in model["ratio"]]
    found, runs = 0, 0
    for r in secret_scan.find(docs, model).select("text", secret_scan.written(F.col("base")).alias("b"), secret_scan.written(F.col("spans")).alias("s")).collect():
        spans = [(int(a), secret_scan.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in r.b.split(",") if x)]
        for m in RUN.finditer(r.text):
            runs += 1
            total = 0.0
            for a, b in zip(m[0], m[0][1:]):
                total += ratio[ord(a) * 128 + ord(b)]
            if total / (len(m[0]) - 1) > model["threshold"] and not any(a < m.end() and m.start() < b for a, k, b in spans if k < 3):
                spans.append((m.start(), 3, m.end()))
                found += 1
        assert r.s == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    assert found and runs > found


def test_sample_of_copies(spark):
    """A text that all rows share is drawn once at most."""
    df = spark.range(5000).selectExpr("'alpha beta gamma delta epsilon zeta' AS text").union(spark.range(50).selectExpr("concat('word other thing ', id) AS text"))
    assert secret_scan.identifiers(df, rows=200).where("label = 0").count() <= 51 * 12


def test_texts_are_searched_once(spark, sf_dir):
    """Spark makes an array anew for each mention: the matches are named once, and only the drawn texts are read for both labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select(secret_scan.located(F.col("text"), secret_scan.CANDIDATE).alias("x"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("split(") == 1
    assert not any("documents.parquet" in f for f in secret_scan.identifiers(docs).inputFiles())
