"""Repeated passages: against brute force, and edges."""

import random
import re

from wordloom.llm import queries, substring_dedup


def parts_of(text):
    """The parts again, character by character."""
    units, part, marked = [], "", False
    for c in text:
        if marked and not (c in substring_dedup.MARKS + "\n" and part[-1] in substring_dedup.MARKS + "\n" or c.isspace()):
            units.append(part)
            part, marked = "", False
        part += c
        marked = marked or c in substring_dedup.MARKS + "\n"
    out = []
    for u in [*units, part] if part else units:
        spots = [m.span() for m in re.finditer(substring_dedup.WORD_PATTERN, u)]
        ends = [b for (_, a), (b, _) in zip(spots, spots[1:])] + [len(u)]
        at = 0
        for (a, _), end in zip(spots, ends) if len(spots) > 24 else ():
            if ord(u[a]) % 5 == 0:
                out.append(u[at:end])
                at = end
        if at < len(u):
            out.append(u[at:])
    return out


def brute(rows, run=2, words=25):
    """text by (doc_id, text), from word lists rather than hashes."""
    count = lambda u: len(re.findall(substring_dedup.WORD_PATTERN, u))
    plain = lambda u: tuple(" ".join(re.findall(substring_dedup.WORD_PATTERN, u)).rstrip(substring_dedup.MARKS).split())
    first, found = {}, []
    for doc, text in sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        parts = parts_of(text)
        for i in range(len(parts)):
            j, n = i, 0
            while j < len(parts) and (n < words or j - i < run):
                n += count(parts[j])
                j += 1
            if n >= words and j - i >= run:
                key = tuple(plain(p) for p in parts[i:j])
                found.append((doc, text, i, j, key in first))
                first.setdefault(key, 1)
    out = {(d, t): t for d, t in rows}
    for doc, text in out:
        gone = {k for d, t, i, j, late in found if (d, t) == (doc, text) and late for k in range(i, j)}
        if gone:
            out[doc, text] = "".join(p for k, p in enumerate(parts_of(text)) if k not in gone)
    return out


def later_runs(rows, least=50):
    """By (doc_id, text), which words lie in a run of `least` words that came earlier: no sentences, marks or hashes."""
    first, gone = set(), {}
    for doc, text in sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        words = re.findall(substring_dedup.WORD_PATTERN, text)
        for i in range(len(words) - least + 1):
            key = tuple(words[i : i + least])
            if key in first:
                gone.setdefault((doc, text), set()).update(range(i, i + least))
            first.add(key)
    return gone


def test_word_runs(spark):
    """What the rule does about every passage of 50 words that came earlier, in the whole table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = later_runs(rows)
    gone = [k for k in found if len(set(re.findall(substring_dedup.WORD_PATTERN, k[1]))) > 20]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    touched = sum(got[d].n_removed > 0 for d, _ in gone)
    assert len(gone) > 100 and touched >= 0.99 * len(gone)
    # Where no run of 50 words came earlier, little goes: shorter repeats of whole sentences.
    assert sum(got[d].n_removed > 0 for d, t in rows if (d, t) not in found) < 0.03 * len(rows)


def test_without_marks(spark):
    """Passages in texts without marks, in clauses, and in Chinese: nearly all of the later copy goes, nothing of what is around."""
    rng = random.Random(7)
    some = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    chinese = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    passages = [some(80), some(30) + ". " + some(50), chinese(80), "\u3002".join(chinese(16) for _ in range(6))]
    rows = [(2 * k + j, f"{(around := chinese if k > 1 else some)(40)} {t} {around(40)}") for k, t in enumerate(passages) for j in (0, 1)]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in enumerate(passages):
        doc = got[2 * k + 1]
        cut = sum(b - a for a, b in (map(int, x.split(":")) for x in doc.removed.split(",")))
        assert got[2 * k].removed == "" and 0.6 * len(t) < cut <= len(t) + 2
        assert rows[2 * k + 1][1].index(t) <= int(doc.removed.split(":")[0]) and doc.text == brute(rows)[rows[2 * k + 1]]


def test_parts():
    for text in ("", "a", "no marks " * 40, "One, two.  Three!\n\nfour", "\u6f22\u5b57\u3002\u4eee\u540d\uff01" * 30, "...!!!\n\n,,,", " lead " + "x1 y2 z3 " * 20):
        assert substring_dedup.units(text) == parts_of(text) and "".join(parts_of(text)) == text


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(rows)
    got = queries.op3_substring_dedup(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[next(k for k in want if k[0] == r.doc_id)]


def test_passage(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    sentence = lambda n: " ".join(word() for _ in range(n))
    text = lambda k: ". ".join(sentence(8) for _ in range(k))
    passage = text(8)
    rows = [(i, text(4) + " " + passage + " and " + text(3) + ".", 1) for i in range(30)]
    got = {r.doc_id: r.text for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, removed int")).collect()}
    inner = passage.split(". ")[1:-1]
    assert got[0] == rows[0][1] and all(s in got[0] for s in inner)
    for i in range(1, 30):
        assert not any(s in got[i] for s in inner) and all(s in got[i] for s in rows[i][1].split(". ")[:3] + rows[i][1][:-1].split(". ")[-2:])


def test_edges(spark):
    long = "w1 w2 w3 w4 w5 w6 w7 w8 w9, v1 v2 v3 v4 v5 v6 v7 v8 v9. u1 u2 u3 u4 u5 u6 u7 u8 u9! "
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long), (None, long), (4, "other words here"), (5, "x. " * 40000), (6, "...!!!\n\n,,,")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS __doc", "2 AS `a.b`")
    got = sorted(((r.doc_id or 99, r.text or "") for r in substring_dedup.dedup(df).collect()))
    assert len(got) == 9
    assert got[:4] == [(1, ""), (2, ""), (3, long), (3, long)] and (4, "") in got and (99, "") in got and (4, "other words here") in got and (6, "...!!!\n\n,,,") in got
    assert substring_dedup.dedup(df.limit(0)).count() == 0
