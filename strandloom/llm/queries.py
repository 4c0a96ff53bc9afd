"""The operators' queries over their whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import collocations, decontamination, fixity, language_model, licenses, lines, minhash, packing, quality, simhash, token_files, toxicity, whitening
from strandloom.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=2, shingle=3)
    return classes.select("doc_id", simhash.hexadecimal("bits").alias("fingerprint"), "component_id")


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC records against a replica in which stated pages are cut short, lost or added."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    cut = F.when(F.pmod("page_id", F.lit(97)) == 5, F.expr("substring(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    kept = pages.where(F.pmod("page_id", F.lit(211)) != 7).withColumn("html", cut)
    added = pages.where(F.pmod("page_id", F.lit(503)) == 11).withColumn("page_id", -F.col("page_id"))
    return fixity.audit(fixity.manifest(pages), fixity.manifest(kept.unionByName(added)))


def _fold(of: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def _held_out(of: int, at: int) -> Column:
    """Whether a row is kept from the fit for tests; a row without an id is not."""
    return F.coalesce(_fold(of) == at, F.lit(False)).alias("held_out")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    tagger = toxicity.train(docs, labels.where(_fold(3) != 1), "toxic")
    scored = toxicity.score(docs, tagger)
    return scored.select("doc_id", _held_out(3, 1), F.col("__score").alias("score"), (F.col("__score") >= 0.7).cast("int").alias("predicted"), F.size("__spans").alias("n_spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(_fold(4) != 2), "quality")
    scored = quality.score(docs, model)
    return scored.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_with_edited(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20)
    named = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), "contaminated")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"), min_chars=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, top=2_000)


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"), of=7, without=2)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


_RECORD = "'WARC/1.0' || crlf || 'WARC-Type: response' || crlf || 'WARC-Target-URI: ' || coalesce(url, '') || crlf || 'Content-Length: ' || strlen(coalesce(html, '')) || crlf || crlf || coalesce(html, '') || crlf || crlf"
_TEMPLATES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
_WORDS = "string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
_BIGRAMS = "list_distinct([w[i] || ' ' || w[i + 1] for i in generate_series(1, len(w) - 1)])"

ORACLE_SQL = {
    "op3_merkle_fixity": f"""
WITH ends AS (SELECT chr(13) || chr(10) AS crlf),
good AS (SELECT page_id, {_RECORD} AS r FROM pages, ends),
copied AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 5 THEN substring(html, 1, length(html) - 1) ELSE html END AS html FROM pages WHERE page_id % 211 <> 7
  UNION ALL SELECT -page_id, url, html FROM pages WHERE page_id % 503 = 11),
bad AS (SELECT page_id, {_RECORD} AS r FROM copied, ends),
replicas AS (SELECT 1 AS side, * FROM good UNION ALL SELECT 2, * FROM bad),
placed AS (
  SELECT side, page_id AS id, floor(page_id / 1000)::BIGINT AS archive, strlen(r)::BIGINT AS size, sha256(r) AS hash FROM replicas),
starts AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY side, archive ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM placed)
SELECT id, coalesce(a.archive, b.archive) AS archive, id - 1000 * coalesce(a.archive, b.archive) AS slot,
       CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra' ELSE 'changed' END AS status,
       a.start, a.size, b.start AS other_start, b.size AS other_size, a.hash AS sha256, b.hash AS other_sha256
FROM (SELECT * FROM starts WHERE side = 1) a FULL JOIN (SELECT * FROM starts WHERE side = 2) b USING (id)
WHERE a.hash IS DISTINCT FROM b.hash""",
    "op6_license_scan": f"""
WITH templates AS (
  SELECT template, license, {_BIGRAMS} AS b FROM (SELECT *, {_WORDS.format("notice")} AS w FROM (VALUES {_TEMPLATES}) AS v(template, license, notice))),
texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
blanks AS (SELECT *, list_transform(parts, lambda x: trim(x, e' \\t\\n\\x0b\\x0c\\r') = '') AS blank FROM texts),
runs AS (
  SELECT doc_id, parts, unnest(list_zip(
    list_filter(generate_series(1, len(parts)), lambda i: NOT blank[i] AND (i = 1 OR blank[i - 1])),
    list_filter(generate_series(1, len(parts)), lambda i: NOT blank[i] AND (i = len(parts) OR blank[i + 1])))) AS run FROM blanks),
units AS (
  SELECT doc_id, unnest(parts) AS unit, generate_subscripts(parts, 1) - 1 AS line, 1 AS n_lines FROM texts
  UNION ALL SELECT doc_id, array_to_string(parts[run[1]:run[2]], chr(10)), run[1] - 1, run[2] - run[1] + 1 FROM runs WHERE run[2] > run[1] AND run[2] - run[1] + 1 < len(parts)
  UNION ALL SELECT doc_id, text, -1, len(parts) FROM texts WHERE len(parts) > 1),
cut AS (SELECT doc_id, line, n_lines, {_BIGRAMS} AS a FROM (SELECT doc_id, line, n_lines, {_WORDS.format("unit")} AS w FROM units) WHERE len(w) >= 2),
scored AS (
  SELECT doc_id, line::INT AS line, n_lines::INT AS n_lines, license, template::INT AS template, round(2 * len(list_intersect(a, b)) / (len(a) + len(b))::DOUBLE, 9) AS dice
  FROM cut, templates WHERE len(a) BETWEEN 2.0 / 3 * len(b) - 1e-9 AND 1.5 * len(b) + 1e-9)
SELECT * FROM scored WHERE dice >= 0.8 - 1e-9""",
    "op8_decontamination": r"""
WITH item_words AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS n FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS i, w FROM doc_words, sizes WHERE len(w) >= n),
found AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM places) p JOIN windows x USING (win, n)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op11_collocations": r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0b\x0c\r]')) AS p FROM texts)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS k),
places AS (SELECT lang, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM pieces, sizes WHERE len(w) >= k),
counts AS (SELECT lang, k, p, array_to_string(p, ' ') AS phrase, f FROM (SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f FROM places GROUP BY ALL) WHERE f >= 30),
cuts AS (SELECT c.lang, c.k, c.p, c.phrase, c.f, a.k AS cut, a.f AS l, b.f AS r, ((2000000::HUGEINT * c.f) // (a.f + b.f))::BIGINT AS score
  FROM counts c JOIN counts a ON a.lang = c.lang AND a.k < c.k AND a.p = c.p[1:a.k] JOIN counts b ON b.lang = c.lang AND b.k = c.k - a.k AND b.p = c.p[a.k + 1:c.k] WHERE c.k > 1),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS pick FROM cuts) WHERE pick = 1),
parts AS (SELECT lang, f, p[i:i + m - 1] AS part, m FROM (SELECT lang, f, k, p, m, unnest(generate_series(1, k - m + 1)) AS i FROM counts, (SELECT unnest([2, 3]) AS m) WHERE m < k)),
most AS (SELECT lang, part, max(f) AS f FROM parts GROUP BY ALL),
left_over AS (SELECT l.* FROM lowest l LEFT JOIN most m ON m.lang = l.lang AND m.part = l.p WHERE m.f IS NULL OR 100 * m.f < 80 * l.f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, encode(phrase)) AS rank FROM left_over)
SELECT lang, rank, phrase, f AS a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op10_line_dedup": """
WITH lines AS (
  SELECT doc_id, u.pos, u.line, translate(trim(u.line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
       LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) u),
owners AS (SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.*, o.k IS NOT NULL AND l.doc_id <> o.owner AS gone FROM lines l LEFT JOIN owners o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
