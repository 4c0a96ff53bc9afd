"""Statistics on tables of identities and on neighbours, clusters and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import pair_key


def reciprocal_means(ani: DataFrame) -> DataFrame:
    """a, b, ani, n: both directions of a pair as one; a name with itself stays."""
    key = pair_key(F.col("query"), F.col("reference"))
    return ani.groupBy(key["a"].alias("a"), key["b"].alias("b")).agg(F.avg("ani").alias("ani"), F.count("*").alias("n"))


def agreement_pairs(one: DataFrame, other: DataFrame) -> DataFrame:
    """query, reference, one, other, delta of the pairs in both tables."""
    joined = one.select("query", "reference", F.col("ani").alias("one")).join(other.select("query", "reference", F.col("ani").alias("other")), ["query", "reference"])
    return joined.withColumn("delta", F.col("other") - F.col("one"))


def only_counts(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: pairs in both, and in one of the tables only."""
    keys = ["query", "reference"]
    marks = one.select(*keys).distinct().withColumn("p", F.lit(1)).join(other.select(*keys).distinct().withColumn("q", F.lit(1)), keys, "full")
    return marks.agg(*[F.count_if(c).alias(n) for n, c in (("shared", F.col("p").isNotNull() & F.col("q").isNotNull()), ("one_only", F.col("q").isNull()), ("other_only", F.col("p").isNull()))])


def running_sums(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """rows with, by name, the sum of a value over the rows of the same keys that come before in order (keys and order tell rows apart).

    Rows are ranged over all tasks by keys and order; a range starts from the sums of the ranges before it. A key with very many rows lies in several
    ranges, and only a sum for each key that a range ends with is handed on.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = {f"__{n}": c for n, c in values.items()}
    ranged = cut(rows.select("*", *[c.cast("long").alias(n) for n, c in names.items()]).repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "__range").agg(*[F.sum(n).alias(f"{n}_sum") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    several = F.count("*").over(Window.partitionBy(*keys)) > 1  # keys that lie in one range start from 0
    starts = sums.select(*keys, "__range", several.alias("__several"), *[F.coalesce(F.sum(f"{n}_sum").over(earlier), F.lit(0)).alias(f"{n}_start") for n in names]).where("__several").drop("__several")
    before = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.select("*", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_in") for n in names])
    joined = within.join(F.broadcast(starts), [*keys, "__range"], "left")  # two keys a range at most
    return joined.select(*rows.columns, *[(F.col(f"{n}_in") + F.coalesce(f"{n}_start", F.lit(0))).alias(n.removeprefix("__")) for n in names])


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with their number from 0 in the order of a column without repeats."""
    return running_sums(rows.withColumn("__all", F.lit(0)), ["__all"], [order], {name: F.lit(1)}).drop("__all")


def ranked_values(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """kind, value, n, below: each different value of each named column, how many rows have it and how many have less; nulls are left out.

    Values are counted where they lie, so ties are one row, then ranged by value over all tasks; a range's rows start from the sums of the ranges
    before it. No task sees more than its range, and only a sum for each range is broadcast. All columns go through one shuffle.
    """
    cells = F.array(*[F.struct(F.lit(kind).alias("kind"), c.cast("double").alias("value")) for kind, c in columns.items()])
    counts = rows.select(F.inline(cells)).where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(counts.repartitionByRange(ranges, "kind", "value").withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("kind", "range").agg(F.sum("n").alias("sum"))
    earlier = Window.partitionBy("kind").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for a range
    starts = sums.select("kind", "range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"))
    less = Window.partitionBy("kind", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("less", F.coalesce(F.sum("n").over(less), F.lit(0)))
    return within.join(F.broadcast(starts), ["kind", "range"]).select("kind", "value", "n", (F.col("start") + F.col("less")).alias("below"))


def exact_quantiles(ranked: DataFrame, points: dict[str, tuple[str, float]]) -> dict[str, float | None]:
    """By name the quantile (kind, share) of ranked_values(), between the two nearest values in proportion; None where there are no values."""
    sizes = {r["kind"]: r["n"] for r in ranked.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    places = {name: (kind, share * (sizes[kind] - 1)) for name, (kind, share) in points.items() if kind in sizes}
    if not places:
        return dict.fromkeys(points)
    at = lambda kind, place: F.max(F.when((F.col("kind") == kind) & (F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col("value")))
    ends = [at(kind, int(end)).alias(f"{i}_{side}") for i, (kind, place) in enumerate(places.values()) for side, end in (("low", place // 1), ("high", -(-place // 1)))]
    row = ranked.agg(*ends).first()
    found = {name: row[f"{i}_low"] + (place - place // 1) * (row[f"{i}_high"] - row[f"{i}_low"]) for i, (name, (_, place)) in enumerate(places.items())}
    return {name: found.get(name) for name in points}


def mean_ranks(rows: DataFrame, value: str, name: str, ranked: DataFrame | None = None) -> DataFrame:
    """rows and their rank by value, ties sharing the mean. ranked: ranked_values() of at least this column, by its name."""
    found = ranked_values(rows, {value: F.col(value)}) if ranked is None else ranked
    ranks = found.where(F.col("kind") == value).select(F.col("value").alias(value), (F.col("below") + (F.col("n") + 1) / 2).alias(name))
    return rows.join(ranks, value)


def agreement(pairs: DataFrame) -> DataFrame:
    """One row of statistics of agreement_pairs."""
    pairs = cut(pairs)
    d, a = F.col("delta"), F.abs("delta")
    values = cut(ranked_values(pairs, {"one": F.col("one"), "other": F.col("other"), "delta": d, "size": a}))
    medians = exact_quantiles(values, {"delta": ("delta", 0.5), "size": ("size", 0.5)})
    ranked = mean_ranks(mean_ranks(pairs, "one", "r1", values), "other", "r2", values)
    median = lambda name: F.lit(medians[name]).cast("double").alias(f"median_{'abs' if name == 'size' else name}")
    return ranked.agg(
        F.count("*").alias("n"), F.corr("one", "other").alias("pearson"), F.corr("r1", "r2").alias("spearman"), F.avg(d).alias("mean_delta"), median("delta"), F.avg(a).alias("mean_abs"),
        median("size"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(a).alias("max_abs"), F.min(a).alias("min_abs"))


def tolerance_recovery(pairs: DataFrame, tolerances: list[float]) -> DataFrame:
    """For each tolerance the share of pairs of which both values are so near, and the errors."""
    listed = F.explode(F.array(*[F.lit(float(t)) for t in tolerances])).alias("tolerance")
    d = F.col("delta")
    return pairs.select("delta", listed).groupBy("tolerance").agg(
        F.count("*").alias("pairs"), F.count_if(F.abs(d) <= F.col("tolerance")).alias("within"), (F.count_if(F.abs(d) <= F.col("tolerance")) / F.count("*")).alias("recovery"),
        F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"))


def quantiles(rows: DataFrame, value: str, points: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """One row: n, mean, min, max and exact quantiles, without a sort or a buffer of all values in one task."""
    names = [f"p{round(100 * p):02d}" for p in points]
    found = exact_quantiles(cut(ranked_values(rows, {value: F.col(value)})), {name: (value, p) for name, p in zip(names, points)})
    return rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), *[F.lit(found[name]).cast("double").alias(name) for name in names])


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).alias("low")).agg(F.count("*").alias("n"))


def nearest(scores: DataFrame, k: int, query: str = "query", candidate: str = "candidate", score: str = "score") -> DataFrame:
    """The k candidates of the highest score for each query, by name where equal, with their rank."""
    order = Window.partitionBy(query).orderBy(F.desc(score), candidate)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame, k: int, query: str = "query", candidate: str = "candidate") -> DataFrame:
    """query, recall: the share of k true neighbours that were found."""
    hit = truth.select(query, candidate).join(found.select(query, candidate).withColumn("__there", F.lit(1)), [query, candidate], "left")
    return hit.groupBy(query).agg((F.count("__there") / F.lit(float(k))).alias("recall"))


def greedy_clusters(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """name, representative: going down by length (then name), a node that no representative before it is linked with becomes one; others join the first linked.

    nodes: name, length; edges: a, b in either direction. Each round settles all nodes whose earlier neighbours are settled, so rounds are few although the
    definition goes node by node.
    """
    order = F.struct((-F.col("length")).alias("l"), F.col("name").alias("n"))
    ranked = cut(nodes.select("name", order.alias("rank")))  # read three times
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    earlier = both.join(ranked.select(F.col("name").alias("a"), F.col("rank").alias("ra")), "a").join(ranked.select(F.col("name").alias("b"), F.col("rank").alias("rb")), "b").where("rb < ra").select("a", "b", "rb")
    earlier = cut(earlier)
    state = cut(ranked.select("name", F.lit(None).cast("boolean").alias("rep")))
    for _ in range(rounds):
        known = state.where("rep is not null").select(F.col("name").alias("b"), "rep")
        seen = earlier.join(known, "b", "left").groupBy(F.col("a").alias("name")).agg(F.max("rep").alias("some"), F.count_if(F.col("rep").isNull()).alias("open"))
        decided = F.when(F.col("some"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = cut(state.join(seen, "name", "left").select("name", F.coalesce("rep", decided).alias("rep")))
        if state.where("rep is null").isEmpty():
            break
    else:
        raise RuntimeError(f"clusters did not settle in {rounds} rounds")
    reps = state.where("rep").select("name")
    joined = earlier.join(reps.withColumnRenamed("name", "b"), "b").join(state.where("not rep").select(F.col("name").alias("a")), "a")
    members = joined.groupBy(F.col("a").alias("name")).agg(F.min_by("b", "rb").alias("representative"))
    return members.unionByName(reps.select("name", F.col("name").alias("representative")))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share: the one that spark.checkpoint.dir names, and in local mode, where it is unset, one of our own."""
    import tempfile

    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes up to which a table whose rows were counted is broadcast.
BROADCAST_BYTES = 8 << 20


def side_is_small(df: DataFrame, row_bytes: int) -> bool:
    return df.count() * row_bytes <= BROADCAST_BYTES


def side(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, which is cut from its lineage, as a side of a join: broadcast if its rows, counted, are small, and else shuffled."""
    return F.broadcast(df) if side_is_small(df, row_bytes) else df


def partition_agreement(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """One row: pairs of rows that are together by both, by found only and by truth only, with precision, recall and F1.

    Pairs are counted from the sizes of groups, not made.
    """
    pairs = lambda n: n * (n - 1) / 2
    cells = rows.groupBy(truth, found).agg(F.count("*").cast("double").alias("n"))
    sums = [cells.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(name)) for by, name in (((truth, found), "tp"), ((found,), "p"), ((truth,), "t"))]
    one = sums[0].crossJoin(sums[1]).crossJoin(sums[2])  # one row each
    fp, fn = F.col("p") - F.col("tp"), F.col("t") - F.col("tp")
    precision, rec = F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(1.0), F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(1.0)
    return one.select("tp", fp.alias("fp"), fn.alias("fn"), precision.alias("precision"), rec.alias("recall"), F.when(precision + rec > 0, 2 * precision * rec / (precision + rec)).otherwise(0.0).alias("f1"))


def edge_disagreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: undirected edges in both, in one only and in the other only."""
    undirected = lambda e: e.select(F.least("a", "b").alias("query"), F.greatest("a", "b").alias("reference")).where("query <> reference")
    return only_counts(undirected(one), undirected(other))


def best_search_hits(rows: DataFrame, key: str, least_coverage: float) -> DataFrame:
    """The best hit of each query by score, length, then identity, of those that cover enough of it."""
    order = Window.partitionBy(key).orderBy(F.desc("bitscore"), F.desc("length"), F.desc("pident"), "sseqid")
    return rows.where(F.col("qcovhsp") >= least_coverage).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def two_level(rows: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Means by inner and outer, then over the inner ones: n, mean, deviation, standard error, least and most."""
    first = rows.groupBy(*outer, *inner).agg(F.avg(value).alias("m"))
    return first.groupBy(*outer).agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("deviation"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("error"), F.min("m").alias("least"), F.max("m").alias("most"))


def counters(rows: DataFrame, sums: list[str], most: list[str], histogram_of: str, edges: list[int]) -> DataFrame:
    """Merged counters: sums, maxima, and numbers of rows up to each edge and beyond the last."""
    bounds = [None, *edges, None]
    buckets = [F.count_if((F.lit(True) if low is None else F.col(histogram_of) > low) & (F.lit(True) if high is None else F.col(histogram_of) <= high)).alias(f"bucket_{i}") for i, (low, high) in enumerate(zip(bounds, bounds[1:]))]
    return rows.agg(*[F.sum(c).alias(f"sum_{c}") for c in sums], *[F.max(c).alias(f"max_{c}") for c in most], *buckets)


def runtime_series(measured: DataFrame) -> DataFrame:
    """samples, method, minutes, speedup (against the slowest method of a size): hours and minutes brought together."""
    minutes = F.when(F.col("unit") == "h", F.col("time") * 60).otherwise(F.col("time"))
    rows = measured.select("samples", "method", minutes.alias("minutes"))
    return rows.withColumn("speedup", F.max("minutes").over(Window.partitionBy("samples")) / F.col("minutes"))


def scaling_curve(rows: DataFrame, anchor_workers: int, anchor_speedup: float) -> DataFrame:
    """rows (workers) with the speedup that a serial share fitted at one measured point leaves."""
    serial = (anchor_workers / anchor_speedup - 1) / (anchor_workers - 1)
    return rows.withColumn("speedup", F.col("workers") / (1 + serial * (F.col("workers") - 1)))
