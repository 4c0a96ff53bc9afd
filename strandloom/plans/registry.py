"""Queries by name over the driver's tables, and DuckDB SQL for those that SQL can express.

Documents are the reference sequences (language and source the genome, the document the contig) and benchmark items the queries.
Hashes are the 60 bits of MD5 that both engines have; places count from 0.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.functions import sequences as sq
from strandloom.functions import statistics as st
from strandloom.operators import analytics, base_level, intervals, mapping, neighbours, order, reduce, seeds, sketch, studies
from strandloom.operators.analytics import cut, side
from strandloom.plans.compare import compare, compare_split, map_fragments, query_sketches, reference_index
from strandloom.plans import table_functions
from strandloom.plans.report import counters
from strandloom.sources import fastx, sinks
from strandloom.sources.tables import load, passages, references

FLAGSHIP = "diagonal_clusters"
K, W, BIN, LEAST, SKETCH, TILE = 12, 8, 50, 3, 200, 400
#: The hash that the SQL has too; bench.py puts the one here that comparisons use by default.
HASH = "md5_60"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Parts that queries share.

_BASES = f"translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{sq.LETTERS}', '{sq.LETTER_BASES}')"
_REFS = f"refs AS (SELECT concat_ws('/', lang, source) AS genome, doc_id AS contig, {_BASES} AS seq FROM documents)"
_ITEMS = f"items AS (SELECT item_id AS item, {_BASES} AS seq FROM benchmark)"


def _kmers(source: str, key: str) -> str:
    """CTEs kmers_<source> and min_<source>: canonical hashes, and window minimizers."""
    h = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
places_{source} AS (SELECT {key}, seq, unnest(generate_series(0, length(seq) - {K})) AS pos FROM {source} WHERE length(seq) >= {K}),
both_{source} AS (SELECT {key}, pos, {h.format(f"substr(seq, pos + 1, {K})")} AS a, {h.format(f"reverse(translate(substr(seq, pos + 1, {K}), 'ACGT', 'TGCA'))")} AS b FROM places_{source}),
kmers_{source} AS (SELECT {key}, pos, CASE WHEN a <> b THEN least(a, b) END AS hash FROM both_{source}),
windows_{source} AS (SELECT {key}, pos, min(hash) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS hash, max(pos) OVER (PARTITION BY {key}) AS last FROM kmers_{source}),
marked_{source} AS (SELECT {key}, pos, hash, lag(hash) OVER (PARTITION BY {key} ORDER BY pos) AS before FROM windows_{source} WHERE pos + {W - 1} <= last),
min_{source} AS (SELECT {key}, hash, pos FROM marked_{source} WHERE hash IS NOT NULL AND hash IS DISTINCT FROM before)"""


_REF_MINIMIZERS = f"{_REFS}, {_kmers('refs', 'contig')}"
_ITEM_SKETCHES = f"{_ITEMS}, {_kmers('items', 'item')}, sketch AS (SELECT item, hash, min(pos) AS qpos FROM min_items GROUP BY item, hash)"
_HITS = f"{_REF_MINIMIZERS}, {_ITEM_SKETCHES}, hits AS (SELECT item, contig, hash, qpos, pos FROM sketch JOIN min_refs USING (hash))"
_CLUSTERS = f"""{_HITS}, clusters AS (SELECT item, contig, floor((pos - qpos) / {BIN}.0)::BIGINT AS bin, count(*) AS n_hits, count(DISTINCT qpos) AS n_places FROM hits GROUP BY ALL HAVING count(DISTINCT qpos) >= {LEAST})"""
_CANDIDATES = f"""{_CLUSTERS}, ranges AS (SELECT item, contig, greatest(bin * {BIN} - {BIN}, 0) AS start, bin * {BIN} + 2 * {BIN} AS "end" FROM clusters),
edges AS (SELECT *, max("end") OVER (PARTITION BY item, contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ranges),
islands AS (SELECT *, sum(CASE WHEN before IS NULL OR before + 1 < start THEN 1 ELSE 0 END) OVER (PARTITION BY item, contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM edges),
candidates AS (SELECT item, contig, min(start)::BIGINT AS start, max("end")::BIGINT AS "end" FROM islands GROUP BY item, contig, island)"""


def _minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.minimizers(references(spark, sf_dir), ["genome", "contig"], K, W, HASH)


def _sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.sketches(passages(spark, sf_dir).withColumnRenamed("contig", "item"), ["item"], K, W, HASH)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.hits(side(cut(_sketches(spark, sf_dir)), 40), _minimizers(spark, sf_dir).select("contig", "hash", "pos"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.clusters(_hits(spark, sf_dir), ["item", "contig"], BIN, LEAST)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = _clusters(spark, sf_dir).select("item", "contig", F.greatest(F.col("bin") * BIN - BIN, F.lit(0)).alias("start"), (F.col("bin") * BIN + 2 * BIN).alias("end"))
    return intervals.merge(ranges, ["item", "contig"])


# Sequences and fragments.


@query(f"WITH {_REFS} SELECT genome, contig, length(seq)::BIGINT AS bases, md5(seq) AS digest FROM refs")
def dna_encode(spark, sf_dir):
    return references(spark, sf_dir).select("genome", "contig", F.length("seq").cast("long").alias("bases"), F.md5("seq").alias("digest"))


@query(f"WITH {_REFS} SELECT contig, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM refs")
def reverse_complement(spark, sf_dir):
    return references(spark, sf_dir).select("contig", F.md5(sq.reverse_complement(F.col("seq"))).alias("digest"))


@query(f"SELECT doc_id, md5(reverse(translate(text, '{sq.IUPAC}', '{sq.IUPAC_COMPLEMENT}'))) AS digest FROM documents")
def iupac_reverse_complement(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(sq.iupac_reverse_complement(F.col("text"))).alias("digest"))


@query(f"""WITH {_REFS}, sized AS (SELECT genome, contig, seq, floor(length(seq) / {TILE})::BIGINT AS n, sum(length(seq)) OVER w AS base, sum(floor(length(seq) / {TILE})::BIGINT) OVER w AS first
  FROM refs WINDOW w AS (PARTITION BY genome ORDER BY contig ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tiles AS (SELECT *, unnest(generate_series(0, n - 1)) AS tile FROM sized WHERE n > 0)
SELECT genome, contig, (coalesce(first, 0) + tile)::BIGINT AS frag, (coalesce(base, 0) + tile * {TILE})::BIGINT AS global_start, md5(substr(seq, tile * {TILE} + 1, {TILE})) AS digest FROM tiles""")
def fragment_tiles(spark, sf_dir):
    return sketch.fragments(references(spark, sf_dir), TILE).select("genome", "contig", "frag", "global_start", F.md5("seq").alias("digest"))


@query(f"""WITH {_REFS} SELECT genome, contig, length(seq)::BIGINT AS length,
  coalesce(sum(length(seq)) OVER (PARTITION BY genome ORDER BY contig ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM refs""")
def contig_offsets(spark, sf_dir):
    return sinks.offsets(references(spark, sf_dir))


@query(f"WITH {_REFS} SELECT genome, sum(length(seq))::BIGINT AS length, count(*) AS contigs, count(*) FILTER (length(seq) < {TILE}) AS short_contigs FROM refs GROUP BY genome")
def genome_lengths(spark, sf_dir):
    n = F.length("seq")
    return references(spark, sf_dir).groupBy("genome").agg(F.sum(n).alias("length"), F.count("*").alias("contigs"), F.count_if(n < TILE).alias("short_contigs"))


@query("""WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(upper(text), '[ACGT]+')) AS run FROM documents)
SELECT doc_id, count(*) AS runs, sum(length(run))::BIGINT AS bases, max(length(run))::BIGINT AS longest FROM runs GROUP BY doc_id""")
def acgt_runs(spark, sf_dir):
    runs = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.upper("text"), F.lit("[ACGT]+"), 0)).alias("run"))
    return runs.groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum(F.length("run")).alias("bases"), F.max(F.length("run")).cast("long").alias("longest"))


# Sketches.


@query(f"WITH {_REF_MINIMIZERS} SELECT contig, count(*) AS n, count(DISTINCT hash) AS n_different, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last, sum(hash % 1000003)::BIGINT AS checksum FROM min_refs GROUP BY contig")
def minimizer_density(spark, sf_dir):
    return sketch.density(references(spark, sf_dir), "contig", K, W, HASH)


@query(f"WITH {_ITEM_SKETCHES} SELECT item, hash, qpos::BIGINT AS qpos, count(*) OVER (PARTITION BY item) AS sketch_size FROM sketch")
def fragment_sketches(spark, sf_dir):
    return _sketches(spark, sf_dir)


@query(f"""WITH {_ITEMS}, {_kmers('items', 'item')}, ranked AS (SELECT item, hash, min(pos)::BIGINT AS qpos, row_number() OVER (PARTITION BY item ORDER BY hash) AS n FROM kmers_items WHERE hash IS NOT NULL GROUP BY item, hash)
SELECT item, hash, qpos FROM ranked WHERE n <= 32""")
def bottom_sketches(spark, sf_dir):
    return sketch.sketches(passages(spark, sf_dir).withColumnRenamed("contig", "item"), ["item"], K, W, HASH, "minmer", size=32).drop("sketch_size")


@query(f"""WITH {_REF_MINIMIZERS}, counts AS (SELECT hash, count(*) AS hits FROM min_refs GROUP BY hash) SELECT hits, count(*) AS n_hashes FROM counts GROUP BY hits""")
def hash_frequency(spark, sf_dir):
    return seeds.frequencies(_minimizers(spark, sf_dir)).groupBy("hits").agg(F.count("*").alias("n_hashes"))


@query(f"""WITH {_REF_MINIMIZERS}, counts AS (SELECT hash, count(*) AS hits FROM min_refs GROUP BY hash),
ranked AS (SELECT hits, row_number() OVER (ORDER BY hits DESC) AS n, count(*) OVER () AS of FROM counts)
SELECT min(hits) AS threshold FROM ranked WHERE n <= floor(of * 0.005)""")
def frequency_threshold(spark, sf_dir):
    return seeds.frequency_threshold(seeds.frequencies(_minimizers(spark, sf_dir)), 0.5)


@query(f"""WITH {_REF_MINIMIZERS}, counts AS (SELECT hash, count(*) AS hits FROM min_refs GROUP BY hash),
ranked AS (SELECT hits, row_number() OVER (ORDER BY hits DESC) AS n, count(*) OVER () AS of FROM counts),
top AS (SELECT min(hits) AS threshold FROM ranked WHERE n <= floor(of * 0.005))
SELECT contig, count(*) AS n_kept FROM min_refs JOIN counts USING (hash), top WHERE hits < threshold GROUP BY contig""")
def hot_key_filter(spark, sf_dir):
    return seeds.without_hot(_minimizers(spark, sf_dir), 0.5).groupBy("contig").agg(F.count("*").alias("n_kept"))


# Seeds, diagonals, intervals.


@query(f"WITH {_HITS} SELECT item, contig, count(*) AS n_hits, count(DISTINCT hash) AS n_hashes, min(pos - qpos)::BIGINT AS low, max(pos - qpos)::BIGINT AS high FROM hits GROUP BY item, contig")
def seed_hits(spark, sf_dir):
    d = F.col("pos") - F.col("qpos")
    return _hits(spark, sf_dir).groupBy("item", "contig").agg(F.count("*").alias("n_hits"), F.countDistinct("hash").alias("n_hashes"), F.min(d).alias("low"), F.max(d).alias("high"))


@query(f"WITH {_CLUSTERS} SELECT * FROM clusters")
def diagonal_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir)


@query(f"WITH {_CANDIDATES} SELECT * FROM candidates")
def interval_merge(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query(f"""WITH {_CANDIDATES} SELECT item, contig, sum("end" - start + 1)::BIGINT AS covered FROM candidates GROUP BY item, contig""")
def interval_coverage(spark, sf_dir):
    ranges = _clusters(spark, sf_dir).select("item", "contig", F.greatest(F.col("bin") * BIN - BIN, F.lit(0)).alias("start"), (F.col("bin") * BIN + 2 * BIN).alias("end"))
    return intervals.coverage(ranges, ["item", "contig"])


@query(f"""WITH {_CANDIDATES} SELECT c.item, c.contig, c.start, c."end", count(*) AS n_minimizers FROM candidates c JOIN min_refs m ON m.contig = c.contig AND m.pos BETWEEN c.start AND c."end" GROUP BY ALL""")
def candidate_range_join(spark, sf_dir):
    candidates = cut(_candidates(spark, sf_dir))
    contigs = side(cut(candidates.select("contig").distinct()), 16)
    points = sketch.minimizers(references(spark, sf_dir).join(contigs, "contig", "left_semi"), ["contig"], K, W, HASH)  # no others are needed
    found = intervals.points_within(side(candidates, 40), points.select("contig", "pos"), ["contig"], 256)
    return found.groupBy("item", "contig", "start", "end").agg(F.count("*").alias("n_minimizers"))


@query(f"""WITH {_HITS}, spans AS (SELECT item, contig, greatest(min(pos) - 100, 0) AS start, max(pos) + 100 AS "end" FROM hits GROUP BY item, contig, floor((pos - qpos) / 200.0))
SELECT a.item, b.item AS other_item, a.contig, count(*) AS n FROM spans a JOIN spans b ON a.contig = b.contig AND a.item < b.item AND a.start <= b."end" AND b.start <= a."end" GROUP BY ALL""")
def interval_overlap_join(spark, sf_dir):
    spans = seeds.diagonals(_hits(spark, sf_dir), ["item", "contig"], 200).groupBy("item", "contig", "bin").agg(F.greatest(F.min("pos") - 100, F.lit(0)).alias("start"), (F.max("pos") + 100).alias("end"))
    found = spans.select("item", "contig", "start", "end")
    others = found.select("contig", F.col("item").alias("other_item"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return intervals.overlapping(found, others, ["contig"], 256).where("item < other_item").groupBy("item", "other_item", "contig").agg(F.count("*").alias("n"))


@query(f"""WITH {_HITS}, numbered AS (SELECT item, contig, pos, row_number() OVER (PARTITION BY item, contig ORDER BY pos) AS n FROM hits),
found AS (SELECT a.item, a.contig, greatest(b.pos - 199, 0) AS start, a.pos AS "end" FROM numbered a JOIN numbered b ON a.item = b.item AND a.contig = b.contig AND b.n = a.n + {LEAST - 1} AND b.pos - a.pos < 200),
edges AS (SELECT *, max("end") OVER (PARTITION BY item, contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM found),
islands AS (SELECT *, sum(CASE WHEN before IS NULL OR before < start THEN 1 ELSE 0 END) OVER (PARTITION BY item, contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM edges)
SELECT item, contig, min(start)::BIGINT AS start, max("end")::BIGINT AS "end" FROM islands GROUP BY item, contig, island""")
def consecutive_regions(spark, sf_dir):
    hits = _hits(spark, sf_dir).select("item", "contig", "pos", F.lit(LEAST).alias("least"), F.lit(200).alias("query_len"))
    return seeds.consecutive_regions(hits, ["item", "contig"], "least", "query_len")


@query(f"""WITH {_HITS}, marks AS (SELECT item, contig, pos AS place, 1 AS step FROM hits UNION ALL SELECT item, contig, pos + 60, -1 FROM hits),
steps AS (SELECT item, contig, place, sum(step) AS step FROM marks GROUP BY item, contig, place),
depths AS (SELECT item, contig, place AS start, sum(step) OVER w AS depth, lead(place) OVER w - 1 AS "end" FROM steps WINDOW w AS (PARTITION BY item, contig ORDER BY place)),
deep AS (SELECT * FROM depths WHERE depth >= {LEAST} AND "end" IS NOT NULL),
edges AS (SELECT *, max("end") OVER (PARTITION BY item, contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM deep),
islands AS (SELECT *, sum(CASE WHEN before IS NULL OR before + 1 < start THEN 1 ELSE 0 END) OVER (PARTITION BY item, contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM edges)
SELECT item, contig, min(start)::BIGINT AS start, max("end")::BIGINT AS "end" FROM islands GROUP BY item, contig, island""")
def depth_sweep(spark, sf_dir):
    spans = _hits(spark, sf_dir).select("item", "contig", F.col("pos").alias("start"), (F.col("pos") + 59).alias("end"))
    return intervals.deep(spans, ["item", "contig"], LEAST)


# Genomes against each other, by bottom sketches.

_PAIRS = f"""{_REF_MINIMIZERS}, named AS (SELECT DISTINCT genome, hash FROM min_refs JOIN refs USING (contig)),
ranked AS (SELECT genome, hash, row_number() OVER (PARTITION BY genome ORDER BY hash) AS rank FROM named),
sketches AS (SELECT * FROM ranked WHERE rank <= {SKETCH}), sizes AS (SELECT genome, count(*) AS n FROM sketches GROUP BY genome),
shared AS (SELECT a.genome AS query, b.genome AS reference, count(*) AS shared, count(*) FILTER (a.rank <= 100 AND b.rank <= 100) AS shared_100 FROM sketches a JOIN sketches b USING (hash) GROUP BY ALL),
pairs AS (SELECT query, reference, shared, shared_100, shared / (x.n + y.n - shared)::DOUBLE AS j, shared_100 / (least(x.n, 100) + least(y.n, 100) - shared_100)::DOUBLE AS j_100
  FROM shared JOIN sizes x ON x.genome = query JOIN sizes y ON y.genome = reference)"""


def _sql_distance(j: str, model: str) -> str:
    between = f"-ln(2 * {j} / (1 + {j})) / {K}" if model == "poisson" else f"1 - pow(2 * {j} / (1 + {j}), 1.0::DOUBLE / {K})"
    return f"CASE WHEN {j} <= 0 THEN 1.0 WHEN {j} >= 1 THEN 0.0 ELSE {between} END"


_ANI = f"{_PAIRS}, a AS (SELECT query, reference, round(100 * (1 - ({_sql_distance('j', 'poisson')})), 9)::DOUBLE AS ani FROM pairs), b AS (SELECT query, reference, round(100 * (1 - ({_sql_distance('j_100', 'poisson')})), 9)::DOUBLE AS ani FROM pairs WHERE shared_100 > 0)"


def _genome_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.bottom_minimizers(references(spark, sf_dir), "genome", SKETCH, K, W, HASH)


def _genome_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = cut(_genome_sketches(spark, sf_dir))  # SKETCH rows a genome at most; what follows reads them often, and texts are sketched once
    sizes = held.groupBy("genome").agg(F.count("*").alias("n"))
    other = held.select(F.col("genome").alias("reference"), "hash", F.col("rank").alias("rank_b"))
    both = held.withColumnRenamed("genome", "query").join(other, "hash").groupBy("query", "reference").agg(F.count("*").alias("shared"), F.count_if((F.col("rank") <= 100) & (F.col("rank_b") <= 100)).alias("shared_100"))
    sized = both.join(sizes.select(F.col("genome").alias("query"), F.col("n").alias("x")), "query").join(sizes.select(F.col("genome").alias("reference"), F.col("n").alias("y")), "reference")
    j = F.col("shared") / (F.col("x") + F.col("y") - F.col("shared"))
    j_100 = F.col("shared_100") / (F.least("x", F.lit(100)) + F.least("y", F.lit(100)) - F.col("shared_100"))
    return sized.select("query", "reference", "shared", "shared_100", j.alias("j"), j_100.alias("j_100"))


def _ani(pairs: DataFrame, j: str) -> DataFrame:
    return pairs.select("query", "reference", F.round(100 * (1 - st.jaccard_to_distance_column(F.col(j), K)), 9).alias("ani"))


def _two_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = _genome_pairs(spark, sf_dir)
    return _ani(pairs, "j"), _ani(pairs.where("shared_100 > 0"), "j_100")


@query(f"WITH {_PAIRS} SELECT query, reference, shared, round(j, 9) AS jaccard, round({_sql_distance('j', 'poisson')}, 9)::DOUBLE AS poisson, round({_sql_distance('j', 'binomial')}, 9)::DOUBLE AS binomial FROM pairs")
def mash_distances(spark, sf_dir):
    j = F.col("j")
    return _genome_pairs(spark, sf_dir).select("query", "reference", "shared", F.round(j, 9).alias("jaccard"), F.round(st.jaccard_to_distance_column(j, K), 9).alias("poisson"), F.round(st.jaccard_to_distance_column(j, K, "binomial"), 9).alias("binomial"))


@query(f"""WITH {_PAIRS}, s AS (SELECT genome, list(hash ORDER BY hash) AS h FROM sketches GROUP BY genome),
u AS (SELECT a.genome AS query, b.genome AS reference, a.h AS x, b.h AS y, list_sort(list_distinct(list_concat(a.h, b.h)))[:{SKETCH}] AS low FROM s a, s b WHERE a.genome < b.genome)
SELECT query, reference, len(list_intersect(low, list_intersect(x, y)))::INT AS shared, len(low)::INT AS of FROM u""")
def jaccard_bottom_union(spark, sf_dir):
    """The bottom-s definition of the union's sketch, for pairs of genomes: a stated set of few sketches against each other."""
    held = _genome_sketches(spark, sf_dir).groupBy("genome").agg(F.sort_array(F.collect_list("hash")).alias("h"))
    pairs = held.select(F.col("genome").alias("query"), F.col("h").alias("x")).join(held.select(F.col("genome").alias("reference"), F.col("h").alias("y")), F.col("query") < F.col("reference"))
    low = F.slice(F.array_sort(F.array_union("x", "y")), 1, SKETCH)
    return pairs.select("query", "reference", F.size(F.array_intersect(low, F.array_intersect("x", "y"))).alias("shared"), F.size(low).alias("of"))


@query(f"WITH {_PAIRS}, d AS (SELECT query, reference, {_sql_distance('j', 'poisson')} AS d FROM pairs) SELECT query, reference, round(exp(-{K} * least(d, 1.0)) / (2 - exp(-{K} * least(d, 1.0))), 9)::DOUBLE AS j FROM d")
def distance_round_trip(spark, sf_dir):
    d = st.jaccard_to_distance_column(F.col("j"), K)
    return _genome_pairs(spark, sf_dir).select("query", "reference", F.round(st.distance_to_jaccard_column(d, K), 9).alias("j"))


@query(f"WITH {_ANI} SELECT least(query, reference) AS a, greatest(query, reference) AS b, round(avg(ani), 6) AS ani, count(*) AS n FROM a GROUP BY ALL")
def reciprocal_average(spark, sf_dir):
    return analytics.reciprocal_means(_two_tables(spark, sf_dir)[0]).withColumn("ani", F.round("ani", 6))


@query(f"WITH {_ANI} SELECT a.query, a.reference, a.ani AS one, b.ani AS other, round(b.ani - a.ani, 6) AS delta FROM a JOIN b USING (query, reference)")
def ani_compare_join(spark, sf_dir):
    return analytics.agreement_pairs(*_two_tables(spark, sf_dir)).withColumn("delta", F.round("delta", 6))


@query(f"WITH {_ANI} SELECT count(*) FILTER (a.query IS NOT NULL AND b.query IS NOT NULL) AS shared, count(*) FILTER (b.query IS NULL) AS one_only, count(*) FILTER (a.query IS NULL) AS other_only FROM a FULL JOIN b ON a.query = b.query AND a.reference = b.reference")
def ani_only_counts(spark, sf_dir):
    return analytics.only_counts(*_two_tables(spark, sf_dir))


@query(f"""WITH {_ANI}, joined AS (SELECT a.ani AS one, b.ani AS other, b.ani - a.ani AS d FROM a JOIN b USING (query, reference)),
r AS (SELECT *, rank() OVER (ORDER BY one) + (count(*) OVER (PARTITION BY one) - 1) / 2.0::DOUBLE AS r1, rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2.0::DOUBLE AS r2 FROM joined)
SELECT count(*) AS n, round(corr(one, other), 6) AS pearson, round(corr(r1, r2), 6) AS spearman, round(avg(d), 6) AS mean_delta, round(median(d), 6) AS median_delta, round(avg(abs(d)), 6) AS mean_abs,
  round(median(abs(d)), 6) AS median_abs, round(sqrt(avg(d * d)), 6) AS rmse, round(max(abs(d)), 6) AS max_abs, round(min(abs(d)), 6) AS min_abs FROM r""")
def agreement_statistics(spark, sf_dir):
    row = analytics.agreement(analytics.agreement_pairs(*_two_tables(spark, sf_dir)))
    return row.select("n", *[F.round(c, 6).alias(c) for c in row.columns if c != "n"])


@query(f"""WITH {_ANI}, joined AS (SELECT b.ani - a.ani AS d FROM a JOIN b USING (query, reference)), t AS (SELECT unnest([1.0, 2.0, 5.0])::DOUBLE AS tolerance)
SELECT tolerance, count(*) AS pairs, count(*) FILTER (abs(d) <= tolerance) AS within, round(count(*) FILTER (abs(d) <= tolerance) / count(*)::DOUBLE, 6) AS recovery, round(avg(abs(d)), 6) AS mae, round(avg(d * d), 6) AS mse, round(sqrt(avg(d * d)), 6) AS rmse FROM joined, t GROUP BY tolerance""")
def tolerance_recovery(spark, sf_dir):
    rows = analytics.tolerance_recovery(analytics.agreement_pairs(*_two_tables(spark, sf_dir)), [1.0, 2.0, 5.0])
    return rows.select("tolerance", "pairs", "within", *[F.round(c, 6).alias(c) for c in ("recovery", "mae", "mse", "rmse")])


@query(f"""WITH {_ANI} SELECT count(ani) AS n, round(avg(ani), 6) AS mean, min(ani) AS min, max(ani) AS max, {", ".join(f"round(quantile_cont(ani, {p}), 6) AS p{round(100 * p):02d}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))} FROM a""")
def quantile_summary(spark, sf_dir):
    row = analytics.quantiles(_two_tables(spark, sf_dir)[0], "ani")
    return row.select("n", F.round("mean", 6).alias("mean"), "min", "max", *[F.round(c, 6).alias(c) for c in row.columns if c[0] == "p"])


@query(f"WITH {_ANI} SELECT floor(ani / 0.5) * 0.5::DOUBLE AS low, count(*) AS n FROM a GROUP BY ALL")
def histogram_half(spark, sf_dir):
    return analytics.histogram(_two_tables(spark, sf_dir)[0], "ani", 0.5)


@query(f"""WITH {_ANI}, e AS (SELECT DISTINCT least(query, reference) AS x, greatest(query, reference) AS y FROM a WHERE ani >= 90 AND query <> reference), f AS (SELECT DISTINCT least(query, reference) AS x, greatest(query, reference) AS y FROM b WHERE ani >= 90 AND query <> reference)
SELECT count(*) FILTER (e.x IS NOT NULL AND f.x IS NOT NULL) AS shared, count(*) FILTER (f.x IS NULL) AS one_only, count(*) FILTER (e.x IS NULL) AS other_only FROM e FULL JOIN f ON e.x = f.x AND e.y = f.y""")
def edge_disagreement(spark, sf_dir):
    edges = [t.where("ani >= 90").select(F.col("query").alias("a"), F.col("reference").alias("b")) for t in _two_tables(spark, sf_dir)]
    return analytics.edge_disagreement(*edges)


def _genome_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = references(spark, sf_dir).groupBy(F.col("genome").alias("name")).agg(F.sum(F.length("seq")).alias("length"))
    edges = _two_tables(spark, sf_dir)[0].where("ani >= 92").select(F.col("query").alias("a"), F.col("reference").alias("b"))
    return analytics.greedy_clusters(nodes, edges)


_NODES = "nodes AS (SELECT genome AS name, sum(length(seq))::BIGINT AS length FROM refs GROUP BY genome)"
_METHODS = "methods AS (SELECT 'all' AS method, least(query, reference) AS a, greatest(query, reference) AS b, ani FROM a WHERE query <> reference UNION ALL SELECT 'few', least(query, reference), greatest(query, reference), ani FROM b WHERE query <> reference)"
_AVERAGED = f"{_METHODS}, averaged AS (SELECT method, a, b, round(avg(ani), 6) AS ani, count(*) AS directions FROM methods GROUP BY ALL UNION ALL SELECT m.method, name, name, 100.0::DOUBLE, 0 FROM nodes, (SELECT DISTINCT method FROM methods) m)"
THRESHOLDS = (88.0, 92.0, 95.0)


def _greedy(groups: str, links: str) -> str:
    """CTE members (method, threshold, name, representative): node by node down the order, each to the first representative that is linked with it."""
    return f"""
linked AS ({links}),
both_ways AS (SELECT DISTINCT method, threshold, a AS name, b AS other FROM linked UNION SELECT DISTINCT method, threshold, b, a FROM linked),
ranked_nodes AS (SELECT method, threshold, name, row_number() OVER (PARTITION BY method, threshold ORDER BY length DESC, name) AS i FROM nodes, ({groups})),
near AS (SELECT r.method, r.threshold, r.i, any_value(r.name) AS name, coalesce(list(x.i) FILTER (x.i IS NOT NULL), []) AS others FROM ranked_nodes r LEFT JOIN both_ways o USING (method, threshold, name)
  LEFT JOIN ranked_nodes x ON x.method = r.method AND x.threshold = r.threshold AND x.name = o.other AND x.i < r.i GROUP BY ALL),
steps AS (SELECT method, threshold, 0::BIGINT AS i, []::BIGINT[] AS reps, 0::BIGINT AS rep FROM ({groups}) UNION ALL
  SELECT s.method, s.threshold, n.i, CASE WHEN len(list_intersect(s.reps, n.others)) = 0 THEN list_append(s.reps, n.i) ELSE s.reps END, coalesce(list_min(list_intersect(s.reps, n.others)), n.i)
  FROM steps s JOIN near n ON n.method = s.method AND n.threshold = s.threshold AND n.i = s.i + 1),
members AS (SELECT s.method, s.threshold, n.name, r.name AS representative FROM steps s JOIN ranked_nodes n USING (method, threshold, i) JOIN ranked_nodes r ON r.method = s.method AND r.threshold = s.threshold AND r.i = s.rep)"""


_ONE_SERIES = f"""RECURSIVE {_ANI}, {_NODES}, {_greedy("SELECT 'all' AS method, 92.0::DOUBLE AS threshold", "SELECT 'all' AS method, 92.0::DOUBLE AS threshold, query AS a, reference AS b FROM a WHERE ani >= 92 AND query <> reference")}"""


@query(f"WITH {_ONE_SERIES} SELECT name, representative FROM members")
def greedy_clusters(spark, sf_dir):
    return _genome_clusters(spark, sf_dir)


@query(f"""WITH {_ONE_SERIES}, m AS (SELECT *, split_part(name, '/', 1) AS lang FROM members), p AS (SELECT x.lang = y.lang AS t, x.representative = y.representative AS f FROM m x, m y WHERE x.name < y.name),
n AS (SELECT count(*) FILTER (t AND f)::DOUBLE AS tp, count(*) FILTER (f AND NOT t)::DOUBLE AS fp, count(*) FILTER (t AND NOT f)::DOUBLE AS fn FROM p),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0::DOUBLE END AS recall FROM n)
SELECT tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END, 9) AS f1 FROM r""")
def cluster_pair_statistics(spark, sf_dir):
    row = analytics.partition_agreement(_genome_clusters(spark, sf_dir).withColumn("lang", F.split("name", "/")[0]), "lang", "representative")
    return row.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _averaged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """name, length of the genomes; method, a, b, ani, directions of both sizes of sketches."""
    nodes = cut(references(spark, sf_dir).groupBy(F.col("genome").alias("name")).agg(F.sum(F.length("seq")).alias("length")))
    tables = [studies.averaged_pairs(t, nodes).select(F.lit(m).alias("method"), "a", "b", F.round("ani", 6).alias("ani"), "directions") for m, t in zip(("all", "few"), _two_tables(spark, sf_dir))]
    return nodes, cut(tables[0].unionByName(tables[1]))


@query(f"WITH {_ANI}, {_NODES}, {_AVERAGED} SELECT method, a, b, ani, directions::BIGINT AS directions FROM averaged")
def averaged_pairs(spark, sf_dir):
    return _averaged(spark, sf_dir)[1]


_SERIES = f"""RECURSIVE {_ANI}, {_NODES}, {_AVERAGED}, listed AS (SELECT unnest([{", ".join(map(str, THRESHOLDS))}])::DOUBLE AS threshold),
{_greedy("SELECT method, threshold FROM (SELECT DISTINCT method FROM methods), listed", "SELECT method, threshold, a, b FROM averaged, listed WHERE a <> b AND ani >= threshold")}"""


@query(f"WITH {_SERIES} SELECT * FROM members")
def threshold_clusters(spark, sf_dir):
    return studies.threshold_clusters(*_averaged(spark, sf_dir), list(THRESHOLDS))


@query(f"""WITH {_SERIES}, sized AS (SELECT method, threshold, representative, count(*) AS n, list(name ORDER BY name) AS held FROM members GROUP BY ALL),
shape AS (SELECT method, threshold, sum(n)::BIGINT AS genomes, count(*) AS clusters, count(*) FILTER (n > 1) AS many, max(n) AS largest FROM sized GROUP BY ALL),
edges AS (SELECT method, threshold, count(*) FILTER (a <> b AND ani >= threshold) AS edges, count(*) AS pairs FROM averaged, listed GROUP BY ALL),
same AS (SELECT threshold, count(*) FILTER (x.representative = t.representative) AS same FROM members x JOIN members t USING (threshold, name) WHERE x.method = 'few' AND t.method = 'all' GROUP BY threshold),
found AS (SELECT threshold, count(*) AS overlap, count(*) FILTER (x.held = t.held) AS exact FROM sized x JOIN sized t USING (threshold, representative) WHERE x.method = 'few' AND t.method = 'all' GROUP BY threshold),
cells AS (SELECT threshold, x.name, x.representative AS f, t.representative AS t FROM members x JOIN members t USING (threshold, name) WHERE x.method = 'few' AND t.method = 'all'),
n AS (SELECT threshold, count(*) FILTER (x.t = y.t AND x.f = y.f) AS tp, count(*) FILTER (x.f = y.f AND x.t <> y.t) AS fp, count(*) FILTER (x.t = y.t AND x.f <> y.f) AS fn FROM cells x JOIN cells y USING (threshold) WHERE x.name < y.name GROUP BY threshold),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1.0::DOUBLE END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1.0::DOUBLE END AS re FROM n)
SELECT m.method, threshold AS threshold_ani, m.genomes AS n_genomes, m.clusters AS n_clusters, t.clusters AS truth_n_clusters, m.clusters - t.clusters AS cluster_delta_vs_truth, m.many AS n_non_singleton_clusters,
  t.many AS truth_n_non_singleton_clusters, m.largest AS largest_cluster_size, t.largest AS truth_largest_cluster_size, e.edges AS n_edges_ge_threshold, u.edges AS truth_edges_ge_threshold, e.edges - u.edges AS edge_delta_vs_truth,
  e.pairs AS averaged_pairs_with_self, (m.genomes * (m.genomes + 1) // 2)::BIGINT AS expected_averaged_pairs_with_self, (m.genomes * (m.genomes + 1) // 2 - e.pairs)::BIGINT AS missing_averaged_pairs_with_self,
  coalesce(overlap, 0) AS representative_overlap, round(coalesce(overlap, 0) / m.clusters::DOUBLE, 6) AS representative_precision, round(coalesce(overlap, 0) / t.clusters::DOUBLE, 6) AS representative_recall,
  same AS same_representative_genomes, round(same / m.genomes::DOUBLE, 6) AS same_representative_fraction, coalesce(exact, 0) AS exact_truth_clusters_recovered, round(coalesce(exact, 0) / t.clusters::DOUBLE, 6) AS exact_truth_cluster_recovery,
  tp AS pair_tp, fp AS pair_fp, fn AS pair_fn, round(pr, 6) AS pair_precision, round(re, 6) AS pair_recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0::DOUBLE END, 6) AS pair_f1
FROM (SELECT * FROM shape WHERE method = 'few') m JOIN (SELECT * FROM shape WHERE method = 'all') t USING (threshold) JOIN (SELECT * FROM edges WHERE method = 'few') e USING (threshold) JOIN (SELECT * FROM edges WHERE method = 'all') u USING (threshold)
  JOIN same USING (threshold) LEFT JOIN found USING (threshold) JOIN r USING (threshold)""")
def threshold_series(spark, sf_dir):
    out = studies.threshold_series(*_averaged(spark, sf_dir), "all", list(THRESHOLDS))
    return out.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" and f.name != "threshold_ani" else f.name for f in out.schema])


_ASKS = "('0x' || substr(md5(repeat || '/' || {}), 1, 8))::BIGINT % 4 = 0"


@query(f"""WITH {_ANI}, {_NODES}, {_AVERAGED}, rounds AS (SELECT unnest(generate_series(1, 10))::INT AS repeat), ks AS (SELECT unnest([1, 3]) AS k),
ways AS (SELECT method, a AS query, b AS found, ani FROM averaged WHERE a <> b UNION ALL SELECT method, b, a, ani FROM averaged WHERE a <> b),
asked AS (SELECT * FROM ways, rounds WHERE {_ASKS.format("query")} AND NOT ({_ASKS.format("found")})),
placed AS (SELECT *, row_number() OVER (PARTITION BY repeat, query, method ORDER BY ani DESC, found) AS place FROM asked),
top AS (SELECT * FROM placed, ks WHERE place <= k),
every AS (SELECT name AS query, repeat, k, 'few' AS method FROM nodes, rounds, ks WHERE {_ASKS.format("name")}),
t AS (SELECT repeat, query, k, count(*) AS truth_size, max(ani) AS truth_best FROM top WHERE method = 'all' GROUP BY ALL),
m AS (SELECT x.repeat, x.query, x.k, count(*) AS method_size, count(y.found) AS recovered FROM top x LEFT JOIN top y ON y.method = 'all' AND y.repeat = x.repeat AND y.query = x.query AND y.k = x.k AND y.found = x.found WHERE x.method = 'few' GROUP BY ALL)
SELECT e.repeat, e.query, e.method, e.k, coalesce(truth_size, 0) AS truth_size, coalesce(method_size, 0) AS method_size, coalesce(recovered, 0) AS recovered, round(coalesce(recovered, 0) / e.k::DOUBLE, 6) AS recall, truth_best
FROM every e LEFT JOIN t USING (repeat, query, k) LEFT JOIN m USING (repeat, query, k)""")
def split_recall(spark, sf_dir):
    nodes, pairs = _averaged(spark, sf_dir)
    return studies.split_recall(nodes.select("name"), pairs, "all", [1, 3], 10, 4).withColumn("recall", F.round("recall", 6))


# Top-1, reductions and orders.

_SCORED = f"{_HITS}, m AS (SELECT item AS query, item % 7 AS frag, genome, contig, min(pos)::BIGINT AS start, floor(count(DISTINCT hash) / 2)::DOUBLE AS identity FROM hits JOIN refs USING (contig) GROUP BY item, genome, contig)"
_BEST = f"{_SCORED}, best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query, genome, frag ORDER BY identity DESC, contig DESC, start DESC) = 1)"
_BEST2 = f"{_BEST}, best2 AS (SELECT *, floor(start / {TILE - 20})::BIGINT AS place_bin FROM best QUALIFY row_number() OVER (PARTITION BY query, genome, contig, place_bin ORDER BY identity DESC, frag DESC) = 1)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share hashes with a passage, as mappings whose identity is half the number of shared hashes."""
    genomes = references(spark, sf_dir).select("genome", "contig")
    grouped = _hits(spark, sf_dir).groupBy("item", "contig").agg(F.min("pos").alias("start"), F.floor(F.countDistinct("hash") / 2).cast("double").alias("identity"))
    return grouped.join(genomes, "contig").select(F.col("item").alias("query"), (F.col("item") % 7).alias("frag"), "genome", "contig", "start", "identity")


@query(f"WITH {_BEST} SELECT * FROM best")
def best_per_fragment(spark, sf_dir):
    return reduce.best_per_fragment(_scored(spark, sf_dir))


@query(f"WITH {_BEST2} SELECT * FROM best2")
def best_per_bin(spark, sf_dir):
    return reduce.best_per_bin(reduce.best_per_fragment(_scored(spark, sf_dir)), TILE)


@query(f"WITH {_BEST2} SELECT query, genome, round(avg(identity), 6) AS ani, count(*) AS mapped FROM best2 GROUP BY query, genome ORDER BY ani DESC, query, genome")
def genome_identities(spark, sf_dir):
    return reduce.ordered(reduce.genome_identities(_scored(spark, sf_dir), TILE).withColumn("ani", F.round("ani", 6)))


@query("""WITH d AS (SELECT doc_id, lang, source, n_chars FROM documents) SELECT doc_id, lang, source, n_chars FROM d
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) <= 3""")
def longest_contigs(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("n_chars"), "doc_id")
    return docs.withColumn("n", F.row_number().over(best)).where("n <= 3").drop("n")


@query("""WITH r AS (SELECT l_orderkey AS qseqid, l_partkey::VARCHAR AS sseqid, l_tax * 100 AS pident, l_quantity::BIGINT AS length, round(l_extendedprice / 1000, 0) AS bitscore, 60 + l_discount * 400 AS qcovhsp FROM lineitem)
SELECT qseqid, sseqid, length, bitscore FROM r WHERE qcovhsp >= 75 QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, length DESC, pident DESC, sseqid) = 1""")
def best_search_hits(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("qseqid"), F.col("l_partkey").cast("string").alias("sseqid"), (F.col("l_tax") * 100).alias("pident"), F.col("l_quantity").cast("long").alias("length"),
        F.round(F.col("l_extendedprice") / 1000, 0).alias("bitscore"), (60 + F.col("l_discount") * 400).alias("qcovhsp"))
    return analytics.best_search_hits(rows, "qseqid", 75).select("qseqid", "sseqid", "length", "bitscore")


_COSINE = """q AS (SELECT vec_id AS query, embedding AS x FROM embeddings WHERE vec_id % 20 = 0),
scores AS (SELECT query, vec_id AS candidate, round(list_cosine_similarity(x::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE vec_id <> query)"""


def _cosines(spark: SparkSession, sf_dir: str, digits: tuple[int, ...]) -> DataFrame:
    """A stated set of query vectors, every twentieth, against all vectors."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return neighbours.cosine_neighbours(rows, F.col("name") % 20 == 0, 10, digits)


@query(f"WITH {_COSINE} SELECT query, candidate, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rank FROM scores QUALIFY rank <= 10")
def nearest_neighbours(spark, sf_dir):
    return analytics.nearest(_cosines(spark, sf_dir, (6,)).drop("digits"), 10)


@query(f"""WITH {_COSINE}, truth AS (SELECT query, candidate FROM scores QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) <= 10),
found AS (SELECT query, candidate FROM (SELECT query, candidate, round(score, 1) AS score FROM scores) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) <= 10)
SELECT t.query, round(count(f.candidate) / 10.0::DOUBLE, 6) AS recall FROM truth t LEFT JOIN found f USING (query, candidate) GROUP BY t.query""")
def neighbour_recall(spark, sf_dir):
    pairs = cut(_cosines(spark, sf_dir, (6, 1)))
    coarse = analytics.nearest(pairs.where("digits = 1").withColumn("score", F.round("score", 1)), 10)
    return analytics.recall(coarse, analytics.nearest(pairs.where("digits = 6"), 10), 10).withColumn("recall", F.round("recall", 6))


@query("""WITH s AS (SELECT vec_id, label, ('0x' || substr(md5(r || '/' || vec_id), 1, 8))::BIGINT % 10 AS part, r FROM embeddings, (SELECT unnest(generate_series(1, 10)) AS r)),
m AS (SELECT label, r, avg(vec_id) AS m FROM s WHERE part = 0 GROUP BY label, r)
SELECT label, count(*) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS deviation, round(stddev_samp(m) / sqrt(count(*)), 6) AS error, round(min(m), 6) AS least, round(max(m), 6) AS most FROM m GROUP BY label""")
def repeated_split_statistics(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("r"))
    part = F.conv(F.substring(F.md5(F.concat_ws("/", "r", "vec_id")), 1, 8), 16, 10).cast("long") % 10
    out = analytics.two_level(rows.where(part == 0), ["label"], ["r"], "vec_id")
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "error", "least", "most")])


@query("""SELECT sum(n_chars)::BIGINT AS sum_n_chars, sum(doc_id)::BIGINT AS sum_doc_id, max(n_chars) AS max_n_chars, count(*) FILTER (n_chars <= 512) AS bucket_0, count(*) FILTER (n_chars > 512 AND n_chars <= 2048) AS bucket_1,
count(*) FILTER (n_chars > 2048 AND n_chars <= 8192) AS bucket_2, count(*) FILTER (n_chars > 8192) AS bucket_3 FROM documents""")
def counters_rollup(spark, sf_dir):
    return analytics.counters(load(spark, sf_dir, "documents"), ["n_chars", "doc_id"], ["n_chars"], "n_chars", [512, 2048, 8192])


@query("""WITH e AS (SELECT o_custkey AS name, o_orderkey % 100 AS other, o_totalprice AS len FROM orders), u AS (SELECT name, len FROM e UNION ALL SELECT other, len FROM e) SELECT name, max(len) AS length FROM u GROUP BY name""")
def genome_max_lengths(spark, sf_dir):
    rows = load(spark, sf_dir, "orders")
    return studies.side_lengths(rows.withColumn("other", F.col("o_orderkey") % 100), [("o_custkey", "o_totalprice"), ("other", "o_totalprice")])


@query("""WITH r AS (SELECT l_orderkey AS name, l_partkey % 20 AS ref, l_suppkey AS start, l_suppkey + l_quantity AS "end", l_quantity AS len FROM lineitem),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY len DESC, ref, start) = 1)
SELECT name, ref, row_number() OVER (PARTITION BY ref ORDER BY start, "end", len DESC, name) AS place FROM b""")
def contig_order(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), (F.col("l_partkey") % 20).alias("ref"), F.col("l_suppkey").alias("start"), (F.col("l_suppkey") + F.col("l_quantity")).alias("end"), F.col("l_quantity").alias("len"))
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("len"), "ref", "start"))).where("n = 1")
    return best.select("name", "ref", F.row_number().over(Window.partitionBy("ref").orderBy("start", "end", F.desc("len"), "name")).alias("place"))


@query(f"""WITH RECURSIVE {_ANI}, g AS (SELECT genome, row_number() OVER (ORDER BY genome) AS i FROM (SELECT DISTINCT genome FROM refs)),
m AS (SELECT least(x.i, y.i) AS lo, greatest(x.i, y.i) AS hi, avg(ani) AS ani FROM a JOIN g x ON x.genome = query JOIN g y ON y.genome = reference WHERE query <> reference GROUP BY ALL)
SELECT p.genome AS row_name, q.genome AS col_name, CASE WHEN m.ani > 0 THEN printf('%.6f', m.ani) ELSE 'NA' END AS cell FROM g p JOIN g q ON q.i < p.i LEFT JOIN m ON m.lo = q.i AND m.hi = p.i""")
def phylip_cells(spark, sf_dir):
    """The cells of the matrix file's lines, each with the names of its row and column."""
    names = cut(analytics.numbered(references(spark, sf_dir).select("genome").distinct(), "genome", "row"))
    lines = sinks.phylip_lines(_two_tables(spark, sf_dir)[0], names).where("row >= 0")
    cells = lines.select(F.split("value", "\t").alias("cells")).select(F.col("cells")[0].alias("row_name"), F.posexplode(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))).alias("row", "cell"))
    return cells.join(names.select("row", F.col("genome").alias("col_name")), "row").select("row_name", "col_name", "cell")


@query(f"""WITH {_CANDIDATES}, counted AS (SELECT item, count(*) AS minimizers, 0 AS hits, 0 AS bins, 0 AS candidates FROM sketch GROUP BY item UNION ALL SELECT item, 0, count(*), 0, 0 FROM hits GROUP BY item
  UNION ALL SELECT item, 0, 0, count(*), 0 FROM clusters GROUP BY item UNION ALL SELECT item, 0, 0, 0, count(*) FROM candidates GROUP BY item)
SELECT item, sum(minimizers)::BIGINT AS minimizers, sum(hits)::BIGINT AS hits, sum(bins)::BIGINT AS bins, sum(candidates)::BIGINT AS candidates FROM counted GROUP BY item""")
def stage_counters(spark, sf_dir):
    """How many rows each stage has for each query, queries without hits included."""
    stages = {"minimizers": _sketches(spark, sf_dir), "hits": _hits(spark, sf_dir), "bins": _clusters(spark, sf_dir), "candidates": _candidates(spark, sf_dir)}
    return counters(stages, "item")


@query(f"WITH {_ANI} SELECT query, reference, rank() OVER (ORDER BY ani) + (count(*) OVER (PARTITION BY ani) - 1) / 2.0::DOUBLE AS place FROM a WHERE ani IS NOT NULL")
def identity_ranks(spark, sf_dir):
    return analytics.mean_ranks(_two_tables(spark, sf_dir)[0], "ani", "place").select("query", "reference", "place")


@query(f"WITH {_REFS} SELECT contig::VARCHAR AS name, length(seq)::BIGINT AS bases, md5(seq) AS digest FROM refs")
def sequence_files(spark, sf_dir):
    """Documents written as FASTA files with lines of 80 and read back in splits."""
    path = f"{analytics.shared_folder(spark)}/fasta-{uuid.uuid4()}"
    rows = references(spark, sf_dir).select(F.col("contig").alias("order"), F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.regexp_replace("seq", "(.{80})(?=.)", "$1\n")).alias("value"))
    sinks.write_ordered(rows, "order", path)
    found = fastx.read_sequences(spark, [path])
    return found.select("name", F.length("seq").cast("long").alias("bases"), F.md5("seq").alias("digest"))


@query("""SELECT p.n_name AS method, count(*) AS samples, round(sum(s_acctbal * CASE WHEN s_suppkey % 2 = 0 THEN 60 ELSE 1 END), 4) AS minutes FROM supplier JOIN nation p ON s_nationkey = n_nationkey GROUP BY ALL""")
def runtime_units(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    measured = s.select(F.col("s_suppkey").alias("samples"), F.col("n_name").alias("method"), F.col("s_acctbal").alias("time"), F.when(F.col("s_suppkey") % 2 == 0, "h").otherwise("m").alias("unit"))
    return analytics.runtime_series(measured).groupBy("method").agg(F.count("*").alias("samples"), F.round(F.sum("minutes"), 4).alias("minutes"))


# The whole comparison and its array kernels, checked by tests against plain Python.

TEXT = Config(kmer=14, fragment=150, min_identity=80, min_fraction=0.0, window=8, diagonal_bin=100, diagonal_band=50)


def _text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir)


@query()
def mapped_fragments(spark, sf_dir):
    return map_fragments(_text_queries(spark, sf_dir), references(spark, sf_dir), TEXT)


@query()
def compared_genomes(spark, sf_dir):
    return compare(_text_queries(spark, sf_dir), references(spark, sf_dir), TEXT)


@query()
def compared_optimal_chains(spark, sf_dir):
    return compare(_text_queries(spark, sf_dir), references(spark, sf_dir), Config(**(TEXT.__dict__ | {"optimal_chain": True, "model": "binomial"})))


@query()
def compared_exact_minimizers(spark, sf_dir):
    return compare(_text_queries(spark, sf_dir), references(spark, sf_dir), Config(**(TEXT.__dict__ | {"mode": "exact"})))


@query()
def compared_minmers(spark, sf_dir):
    return compare(_text_queries(spark, sf_dir), references(spark, sf_dir), Config(**(TEXT.__dict__ | {"mode": "minmer"})))


@query()
def compared_in_parts(spark, sf_dir):
    return compare_split(_text_queries(spark, sf_dir), references(spark, sf_dir), TEXT, 2)


@query()
def minmer_intervals(spark, sf_dir):
    rows = sketch.minmer_intervals(references(spark, sf_dir), ["contig"], K, 139, 16)
    return rows.groupBy("contig").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("places"))


@query(f"""WITH {_HITS}, strands AS (SELECT item, contig AS ref, pos, qpos, '+' AS strand, pos - qpos AS d FROM hits UNION ALL SELECT item, contig, pos, qpos, '-', pos + qpos FROM hits),
binned AS (SELECT *, floor(d / {BIN}.0)::BIGINT + unnest([0, 1]) AS bin FROM strands),
groups AS (SELECT item, ref, strand, bin, count(DISTINCT qpos) AS n, min(pos) AS start, max(pos) + {K} AS "end" FROM binned GROUP BY ALL HAVING count(DISTINCT qpos) >= 3),
best AS (SELECT * FROM groups QUALIFY row_number() OVER (PARTITION BY item, ref, strand ORDER BY n DESC, bin) = 1),
found AS (SELECT item, ref::VARCHAR AS reference, start, "end", strand, least(n * {K}, "end" - start) AS matches, "end" - start AS aligned, least(60, n) AS mapq FROM best),
top AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY item ORDER BY aligned DESC, matches DESC, mapq DESC, reference, start, strand) = 1),
placed AS (SELECT i.item AS contig, i.item::VARCHAR AS name, length(seq)::BIGINT AS length, t.* FROM items i LEFT JOIN top t USING (item))
SELECT row_number() OVER (ORDER BY reference NULLS LAST, start, "end", length DESC, name)::INT AS "order", contig, name, length, reference, start::BIGINT AS start, "end"::BIGINT AS "end", coalesce(strand, '+') AS strand,
  coalesce(aligned, 0)::BIGINT AS aligned, coalesce(matches, 0)::BIGINT AS matches, coalesce(mapq, 0)::INT AS mapq, CASE WHEN reference IS NULL THEN 'unplaced' ELSE 'placed' END AS status FROM placed""")
def ordered_contigs(spark, sf_dir):
    """Benchmark passages placed along documents."""
    config = Config(kmer=K, fragment=150, window=W, diagonal_bin=BIN, hash=HASH)
    found = order.alignments(passages(spark, sf_dir), references(spark, sf_dir), config)
    return order.placements(passages(spark, sf_dir), found).drop("seq")


@query(f"WITH {_REF_MINIMIZERS} SELECT contig, count(*) AS n, count(DISTINCT hash) AS n_different, sum(hash % 1000003)::BIGINT AS checksum FROM min_refs GROUP BY contig")
def lateral_minimizers(spark, sf_dir):
    """Minimizers by a table function in SQL."""
    table_functions.register(spark)
    return spark.sql(f"SELECT contig, count(*) AS n, count(DISTINCT m.hash) AS n_different, sum(m.hash % 1000003) AS checksum FROM {{refs}}, LATERAL minimizers(seq, {K}, {W}, '{HASH}') m GROUP BY contig", refs=references(spark, sf_dir))


@query()
def aligned_contigs(spark, sf_dir):
    """Benchmark passages aligned base by base with their place in a document."""
    config = Config(kmer=K, fragment=150, window=W, diagonal_bin=BIN, hash=HASH)
    contigs, refs = passages(spark, sf_dir), references(spark, sf_dir)
    placed = cut(order.placements(contigs, order.alignments(contigs, refs, config)))
    return base_level.aligned(contigs, refs, placed, config)


@query()
def visualization_points(spark, sf_dir):
    tiles, _ = query_sketches(_text_queries(spark, sf_dir), TEXT)
    best = reduce.best_both_ways(map_fragments(_text_queries(spark, sf_dir), references(spark, sf_dir), TEXT), TEXT.fragment)
    return sinks.visualization_lines(best, sinks.offsets(references(spark, sf_dir)), tiles)
