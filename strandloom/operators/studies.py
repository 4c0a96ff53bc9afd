"""Studies of methods against a truth: averaged identities, clusters over a series of thresholds, and neighbours over repeated splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import pair_key
from strandloom.operators.analytics import cut, greedy_clusters


def side_lengths(rows: DataFrame, sides: list[tuple[str, str]]) -> DataFrame:
    """name, length: the most that any row gives a name, over the (name, length) columns of all sides. Null names are left out."""
    listed = F.explode(F.array(*[F.struct(F.col(n).alias("name"), F.col(x).alias("length")) for n, x in sides])).alias("s")
    return rows.select(listed).select("s.*").where("name is not null").groupBy("name").agg(F.max("length").alias("length"))


def averaged_pairs(directed: DataFrame, names: DataFrame, scale: float = 1.0) -> DataFrame:
    """a, b (a <= b), ani, directions: the mean of both directions of a pair, scaled, without negative or null values; a name with itself has 100."""
    key = pair_key(F.col("query"), F.col("reference"))
    kept = directed.where("ani >= 0 and query <> reference").groupBy(key["a"].alias("a"), key["b"].alias("b"))
    means = kept.agg(F.avg(F.col("ani") * scale).alias("ani"), F.count("*").alias("directions"))
    return means.unionByName(names.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(100.0).alias("ani"), F.lit(0).cast("long").alias("directions")))


def threshold_clusters(nodes: DataFrame, pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """method, threshold, name, representative: greedy clusters for each method and threshold, all in one run.

    nodes: name, length; pairs: method, a, b, ani. Names carry method and threshold while they are clustered, as links never leave either.
    """
    listed = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    key = lambda c: F.struct("method", "threshold", F.col(c).alias("name"))
    methods = pairs.select("method").distinct()
    each = nodes.crossJoin(F.broadcast(methods)).select("method", listed, "name", "length")  # a few methods
    links = pairs.where("a <> b").select("method", "a", "b", "ani", listed).where("ani >= threshold")
    found = greedy_clusters(each.select(key("name").alias("name"), "length"), links.select(key("a").alias("a"), key("b").alias("b")))
    return found.select("name.method", "name.threshold", "name.name", F.col("representative.name").alias("representative"))


def _pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def _shapes(clusters: DataFrame) -> DataFrame:
    sizes = clusters.groupBy("method", "threshold", "representative").agg(F.count("*").alias("size"))
    return sizes.groupBy("method", "threshold").agg(
        F.sum("size").alias("n_genomes"), F.count("*").alias("n_clusters"), F.count_if(F.col("size") > 1).alias("n_non_singleton_clusters"), F.max("size").alias("largest_cluster_size"), F.sum(_pairs_of(F.col("size"))).alias("together"))


def _edges(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    listed = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    counted = pairs.select("method", listed, ((F.col("a") != F.col("b")) & (F.col("ani") >= F.col("threshold"))).alias("linked"))
    return counted.groupBy("method", "threshold").agg(F.count_if("linked").alias("n_edges_ge_threshold"), F.count("*").alias("averaged_pairs_with_self"))


def threshold_series(nodes: DataFrame, pairs: DataFrame, truth: str, thresholds: list[float]) -> DataFrame:
    """A row of 29 figures for each method but the truth and each threshold: its clusters, links and pairs against the truth's.

    nodes: name, length; pairs: method, a, b, ani with a name's pair with itself. All pairs of names are counted from sizes of groups, none are made.
    """
    clusters = cut(threshold_clusters(nodes, pairs, thresholds))
    shapes = _shapes(clusters).join(_edges(pairs, thresholds), ["method", "threshold"])
    true_shape = shapes.where(F.col("method") == truth).drop("method", "n_genomes", "averaged_pairs_with_self")
    true_shape = true_shape.select("threshold", *[F.col(c).alias(f"truth_{c}") for c in true_shape.columns if c != "threshold"])
    mine = clusters.where(F.col("method") != truth)
    theirs = clusters.where(F.col("method") == truth).select("threshold", "name", F.col("representative").alias("truth_rep"))
    cells = mine.join(theirs, ["threshold", "name"]).groupBy("method", "threshold", "representative", "truth_rep").agg(F.count("*").alias("n"))
    sized = cells.withColumn("size", F.sum("n").over(Window.partitionBy("method", "threshold", "representative"))).withColumn("truth_size", F.sum("n").over(Window.partitionBy("method", "threshold", "truth_rep")))
    same = F.col("representative") == F.col("truth_rep")
    overlap = sized.groupBy("method", "threshold").agg(
        F.sum(_pairs_of(F.col("n"))).alias("pair_tp"), F.sum(F.when(same, F.col("n")).otherwise(0)).alias("same_representative_genomes"),
        F.count_if(same & (F.col("n") == F.col("size")) & (F.col("n") == F.col("truth_size"))).alias("exact_truth_clusters_recovered"))
    leads = lambda c: c.where("name = representative")
    both = leads(mine).join(leads(clusters.where(F.col("method") == truth)).select("threshold", "name"), ["threshold", "name"]).groupBy("method", "threshold").agg(F.count("*").alias("representative_overlap"))
    row = shapes.where(F.col("method") != truth).join(true_shape, "threshold").join(overlap, ["method", "threshold"]).join(both, ["method", "threshold"], "left")
    c, tp = F.col, F.col("pair_tp")
    fp, fn, shared = c("together") - tp, c("truth_together") - tp, F.coalesce("representative_overlap", F.lit(0))
    expected = (c("n_genomes") * (c("n_genomes") + 1) / 2).cast("long")
    precision, recall = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    return row.select(
        "method", c("threshold").alias("threshold_ani"), "n_genomes", "n_clusters", "truth_n_clusters", (c("n_clusters") - c("truth_n_clusters")).alias("cluster_delta_vs_truth"),
        "n_non_singleton_clusters", "truth_n_non_singleton_clusters", "largest_cluster_size", "truth_largest_cluster_size",
        "n_edges_ge_threshold", c("truth_n_edges_ge_threshold").alias("truth_edges_ge_threshold"), (c("n_edges_ge_threshold") - c("truth_n_edges_ge_threshold")).alias("edge_delta_vs_truth"),
        "averaged_pairs_with_self", expected.alias("expected_averaged_pairs_with_self"), (expected - c("averaged_pairs_with_self")).alias("missing_averaged_pairs_with_self"),
        shared.alias("representative_overlap"), (shared / c("n_clusters")).alias("representative_precision"), (shared / c("truth_n_clusters")).alias("representative_recall"),
        "same_representative_genomes", (c("same_representative_genomes") / c("n_genomes")).alias("same_representative_fraction"),
        "exact_truth_clusters_recovered", (c("exact_truth_clusters_recovered") / c("truth_n_clusters")).alias("exact_truth_cluster_recovery"),
        tp.cast("long").alias("pair_tp"), fp.cast("long").alias("pair_fp"), fn.cast("long").alias("pair_fn"), precision.alias("pair_precision"), recall.alias("pair_recall"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("pair_f1"))


def split_recall(names: DataFrame, pairs: DataFrame, truth: str, ks: list[int], repeats: int = 10, parts: int = 10) -> DataFrame:
    """repeat, query, method, k, truth_size, method_size, recovered, recall, truth_best: how many of a query's k true neighbours each method finds.

    In each repeat one name in parts is a query, chosen by the MD5 of repeat and name, and the others are the database. Pairs that a method lacks come last, so they
    are no neighbours. A query without any true neighbour has its rows too, with no recovered ones and a null truth_best.
    """
    asks = lambda name: F.conv(F.substring(F.md5(F.concat_ws("/", "repeat", name)), 1, 8), 16, 10).cast("long") % parts == 0
    rounds = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")
    ends = lambda q, d: F.struct(F.col(q).alias("query"), F.col(d).alias("found"))
    directed = pairs.where("a <> b").select("method", "ani", F.explode(F.array(ends("a", "b"), ends("b", "a"))).alias("e")).select("method", "ani", "e.*", rounds).where(asks("query") & ~asks("found"))
    order = Window.partitionBy("repeat", "query", "method").orderBy(F.desc("ani"), "found")
    ranked = directed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(ks))
    listed = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    top = ranked.select("repeat", "query", "method", "found", "ani", "rank", listed).where("rank <= k")
    true_top = top.where(F.col("method") == truth)
    sizes = true_top.groupBy("repeat", "query", "k").agg(F.count("*").alias("truth_size"), F.max("ani").alias("truth_best"))
    marked = top.where(F.col("method") != truth).join(true_top.select("repeat", "query", "k", "found", F.lit(1).alias("hit")), ["repeat", "query", "k", "found"], "left")
    counted = marked.groupBy("repeat", "query", "method", "k").agg(F.count("*").alias("method_size"), F.count("hit").alias("recovered"))
    methods = pairs.select("method").distinct().where(F.col("method") != truth)
    every = names.select(F.col("name").alias("query"), rounds).where(asks("query")).crossJoin(F.broadcast(methods)).select("*", listed)  # a few methods
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = every.join(counted, ["repeat", "query", "method", "k"], "left").join(sizes, ["repeat", "query", "k"], "left")
    return out.select("repeat", "query", "method", "k", zero("truth_size"), zero("method_size"), zero("recovered"), (F.coalesce("recovered", F.lit(0)) / F.col("k")).alias("recall"), "truth_best")
