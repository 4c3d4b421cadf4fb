"""The queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, language_id, packing, quality_classifier, quality_rules, secret_scan, simhash_dedup, substring_dedup, warc, zdict
from .shared import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality_rules.judge(docs, carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), zdict.held_out(F.col("doc_id"))
    model = quality_classifier.learn(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.classes(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), zdict.held_out(F.col("doc_id"))
    dictionaries = language_id.learn(docs.where(~held).select("doc_id", "text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held.alias("held_out"), F.col("lang_best").alias("lang_pred"), "score", "rejected")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secret_scan.train(secret_scan.identifiers(docs))
    found = secret_scan.find(docs, model)
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(secret_scan.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_quality_rules, op3_substring_dedup, op4_quality_classifier, op5_simhash_dedup, op6_warc, op7_byte_bpe, op8_ann, op9_language_id, op10_secret_scan)}


def _rules_sql() -> str:
    """The measures, sketches, fences and verdicts of quality_rules.judge."""
    q = quality_rules
    word = "[^\\x20\\x09-\\x0D]"
    level = lambda k, keys: (
        f"r{k} AS (SELECT {keys} metric, bucket, sum(n) OVER (PARTITION BY {keys} metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys} metric) AS total FROM (SELECT {keys} metric, bucket, sum(n) AS n FROM sk GROUP BY ALL)), "
        f"q{k} AS (SELECT {keys} metric, max(total) AS total, min(bucket) FILTER (100 * upto >= {q._by_metric(1)} * total) AS low, min(bucket) FILTER (100 * upto >= {q._by_metric(2)} * total) AS high FROM r{k} GROUP BY ALL), "
        f"l{k} AS (SELECT {keys} metric, total::DOUBLE AS n, (high + {q._by_metric(3)} * (high - low))::DOUBLE AS own FROM q{k})"
    )
    values = " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS metric, {sql.replace(' div ', ' // ')} AS v FROM b" for m, (sql, *_) in q.METRICS.items())
    return f"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
lw AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{word}') GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS n_letters, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lw USING (doc_id)),
b AS (SELECT *, {q.BASE_FAILED} AS base_failed FROM m),
v AS ({values}),
sk AS (SELECT lang, source, metric, CASE WHEN v < 1024 THEN v ELSE (v >> (length(bin(v)) - 10)) << (length(bin(v)) - 10) END AS bucket, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
{level(0, 'lang, source,')}, {level(1, 'lang,')}, {level(2, '')},
f AS (SELECT l0.lang, l0.source, l0.metric, (l0.n * l0.own + {q.PRIOR_ROWS} * ((l1.n * l1.own + {q.PRIOR_ROWS} * l2.own) / (l1.n + {q.PRIOR_ROWS}))) / (l0.n + {q.PRIOR_ROWS}) AS fence FROM l0 JOIN l1 ON l0.lang IS NOT DISTINCT FROM l1.lang AND l0.metric = l1.metric JOIN l2 ON l0.metric = l2.metric),
o AS (SELECT doc_id, bool_or(coalesce(v > fence, false)) AS outlier FROM v LEFT JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source AND v.metric = f.metric GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT outlier AS kept, n_lines, n_upper FROM b JOIN o USING (doc_id)"""


def _passages_sql() -> str:
    """The parts, spans and removals of substring_dedup.dedup, by the spans' texts."""
    q = substring_dedup
    return f"""WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(text, '{q.UNIT_PATTERN}'), lambda x: x <> '') AS us FROM documents),
un AS (SELECT doc_id, unnest(us) AS raw, unnest(range(len(us))) AS j FROM d),
uw AS (SELECT doc_id, j, raw, regexp_extract_all(raw, '\\s*{q.WORD_PATTERN}\\s*') AS ts FROM un),
tk AS (SELECT doc_id, j, unnest(ts) AS tok, unnest(range(len(ts))) AS k FROM uw WHERE len(ts) > {q.LONG}),
sg AS (SELECT doc_id, j, k, tok, coalesce(sum(CASE WHEN unicode(regexp_extract(tok, '\\S')) % {q.CUT} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, j ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM tk),
pc AS (SELECT doc_id, j, 0 AS s, raw FROM uw WHERE len(ts) <= {q.LONG} UNION ALL SELECT doc_id, j, s, string_agg(tok, '' ORDER BY k) AS raw FROM sg GROUP BY ALL),
u AS (SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY j, s) - 1 AS i FROM pc),
p AS (SELECT doc_id, i, raw, regexp_extract_all(raw, '{q.WORD_PATTERN}') AS ws FROM u),
c AS (SELECT doc_id, i, raw, rtrim(array_to_string(ws, ' '), '{q.MARKS}') AS plain, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY i) - len(ws) + {q.WORDS} AS want, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i) AS stop_at FROM p),
l AS (SELECT doc_id, list(plain ORDER BY i) AS plains FROM c GROUP BY doc_id),
k AS (SELECT doc_id, upto, min(i) AS at FROM c GROUP BY ALL),
r AS (SELECT c.doc_id, c.i, greatest(k.at + 1, c.i + {q.RUN}) AS stop FROM c ASOF JOIN k ON c.doc_id = k.doc_id AND c.want <= k.upto),
runs AS (SELECT doc_id, i, stop, row_number() OVER (PARTITION BY array_to_string(plains[i + 1:stop], chr(1)) ORDER BY doc_id, i) AS nth FROM r JOIN l USING (doc_id) WHERE stop <= len(plains)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, stop)) AS i FROM runs WHERE nth > 1),
m AS (SELECT c.doc_id, c.i, raw, stop_at, gone.i IS NOT NULL AS cut FROM c LEFT JOIN gone ON gone.doc_id = c.doc_id AND gone.i = c.i),
g AS (SELECT doc_id, i, raw, stop_at, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m WHERE cut),
s AS (SELECT doc_id, string_agg(concat(a, ':', b), ',' ORDER BY a) AS removed FROM (SELECT doc_id, min(stop_at - length(raw)) AS a, max(stop_at) AS b FROM g GROUP BY doc_id, island) GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(string_agg(raw, '' ORDER BY i) FILTER (NOT cut), '') AS text, count(*) AS n_sentences, count(*) FILTER (cut) AS n_removed FROM m GROUP BY doc_id)
SELECT documents.doc_id, coalesce(t.text, documents.text) AS text, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": _passages_sql(),
    "op5_simhash_dedup": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0))),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
ed AS (SELECT a, b FROM pr JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
reach AS (SELECT doc_id AS id, doc_id AS r FROM w UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r)
SELECT id AS doc_id, min(r) AS class_id FROM reach GROUP BY id""",
    "op2_quality_rules": _rules_sql(),
    "op6_warc": """WITH s AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM s WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to, url FROM s LEFT JOIN f USING (payload_digest)""",
}
