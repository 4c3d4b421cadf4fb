"""Quality rules: the measures against brute force, the sketches' merging, and edges."""

import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.llm import quality_rules, queries


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["a", "b", " ", "\n", "\t", " ", "\x1c", "#", "|", "\x85", "é "]), max_size=60).map("".join)))
def test_measures(text):
    assert quality_rules.measure_text(text)[:5] == brute(text)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.op2_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)
    clean = [r for r in got if not r.base_failed and labels.get(r.doc_id) == 1]
    junk = [r for r in got if labels.get(r.doc_id) == 0]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean) and sum(r.kept for r in junk) <= 0.1 * len(junk)


def test_sketches_merge(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), rng.choice(["x", "y"]), *[rng.randrange(1, 10**rng.randrange(1, 7)) for _ in quality_rules.MEASURED]) for _ in range(400)]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{m} long" for m in quality_rules.MEASURED))
    one, two = df.limit(150), df.subtract(df.limit(150))
    whole = {tuple(r) for r in quality_rules.fences(quality_rules.sketch(df)).collect()}
    parts = {tuple(r) for r in quality_rules.fences(quality_rules.sketch(one).union(quality_rules.sketch(df.exceptAll(one)))).collect()}
    assert whole == parts and len(whole) == 4 and two.count() <= 250


def fences_of(spark, rows):
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{m} long" for m in quality_rules.MEASURED))
    return {(r.lang, r.source): {m: r[f"fence_{m}"] for m in quality_rules.METRICS} for r in quality_rules.fences(quality_rules.sketch(df)).collect()}


def group(rng, lang, source, scale, n=1500):
    """Documents of 1000 words whose measures spread around `scale`."""
    some = lambda top: max(0, int(rng.gauss(scale, scale / 4) * top / 100))
    return [(lang, source, 1000, 4000 + 10 * some(100), some(20), some(4) if rng.random() < 0.3 else 0, some(30) if rng.random() < 0.3 else 0, 100, some(80), 3000 + some(400)) for _ in range(n)]


def test_fences_adapt(spark):
    """Every measure's fence differs between groups that differ; a source that shifts moves its own fence, hardly the others'."""
    rng = random.Random(5)
    before = {s: group(rng, "en", s, scale) for s, scale in (("a", 40), ("b", 80), ("c", 120))}
    old = fences_of(spark, sum(before.values(), []))
    for m in quality_rules.METRICS:
        assert len({old["en", s][m] for s in before}) == 3
    new = fences_of(spark, sum((before | {"b": group(rng, "en", "b", 240)}).values(), []))
    for m in quality_rules.METRICS:
        moved = {s: abs(new["en", s][m] / old["en", s][m] - 1) for s in before}
        assert moved["b"] > 0.3 and max(moved["a"], moved["c"]) < moved["b"] / 4, (m, moved)


def test_fences_worked(spark):
    """One group of 4 rows, another of 8: the quantiles, the multiple and the means by hand."""
    row = lambda lang, source, chars: (lang, source, 100, chars, 0, 0, 0, 10, 0, chars)
    got = fences_of(spark, [row("en", "a", c) for c in (400, 410, 420, 430)] + [row("en", "b", c) for c in (500, 500, 510, 520, 530, 530, 540, 540)])
    own = 420 + 7 * 20
    lang = 530 + 7 * (530 - 420)
    lang = (12 * lang + 100 * lang) / 112
    assert abs(got["en", "a"]["word_length"] - (4 * own + 100 * lang) / 104) < 1e-9
    own = 530 + 7 * 30
    assert abs(got["en", "b"]["word_length"] - (8 * own + 100 * lang) / 108) < 1e-9


def test_edges(spark):
    text = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(1, text, None, None, 9, "p"), (1, text, None, None, 9, "p"), (2, None, "en", "s", 9, "p"), (3, "", "en", None, 9, "p"), (4, "x " * 50000, "en", "s", 9, "p"), (None, text, "en", "s", 9, "p")], "doc_id long, text string, lang string, source string, kept int, __lang string")
    got = quality_rules.judge(df).collect()
    assert sorted((r.doc_id or 0, r.kept, r.lang or "") for r in got) == [(0, True, "en"), (1, True, ""), (1, True, ""), (2, False, "en"), (3, False, "en"), (4, False, "en")]
    assert quality_rules.judge(df.limit(0)).count() == 0
