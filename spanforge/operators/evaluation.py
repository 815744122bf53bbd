"""Retrieval metrics, label agreement and significance, as tables."""

from __future__ import annotations

import math
import random
import re
import statistics
import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10


def graded_ndcg(run: DataFrame, qrels: DataFrame, k: int = K) -> DataFrame:
    """(query_id, ndcg) of a run (query_id, id, rank) against grades (query_id, id, grade): gain 2^g - 1, ideal over all grades, 0 without any."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    got = run.where(F.col("rank") <= k).join(qrels, ["query_id", "id"]).groupBy("query_id").agg(F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = qrels.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("query_id").agg(F.sum(gain / F.log2(F.col("r") + 1.0)).alias("idcg"))
    return ideal.join(got, "query_id", "left").select("query_id", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def first_hits(run: DataFrame, positives: DataFrame, k: int = K) -> DataFrame:
    """(query_id, first_rank, hit, rr) for every query of ``positives`` (query_id, id); no rank where nothing was found within ``k``."""
    found = run.where(F.col("rank") <= k).join(positives.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    every = positives.select("query_id").distinct().join(found, "query_id", "left")
    return every.select("query_id", "first_rank", F.col("first_rank").isNotNull().cast("double").alias("hit"), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"))


def per_query(run: DataFrame, ceiling: DataFrame, qrels: DataFrame, k: int = K) -> DataFrame:
    """ndcg, hit, rr, first_rank and ceiling_hit of every query with a positive grade."""
    positives = qrels.where("grade >= 1")
    top = first_hits(ceiling, positives, 1 << 30).select("query_id", F.col("hit").alias("ceiling_hit"))
    return graded_ndcg(run, positives, k).join(first_hits(run, positives, k), "query_id").join(top, "query_id")


def report(scores: DataFrame, metrics: list[str], strata: list[str]) -> DataFrame:
    """Means of the metrics over all queries and within each stratum column's values: (stratum, value, n, metric...)."""
    sets = [[c] for c in strata] + [[]]
    means = [F.round(F.avg(m), 4).alias(m) for m in metrics]
    grouped = scores.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in strata]).agg(F.count("*").alias("n"), *means, F.grouping_id().alias("g"))
    width = len(strata)
    of = F.lit("all")
    value = F.lit("all")
    for i, c in enumerate(strata):
        here = F.col("g") == ((1 << width) - 1 - (1 << (width - 1 - i)))
        of, value = F.when(here, F.lit(c)).otherwise(of), F.when(here, F.col(c).cast("string")).otherwise(value)
    return grouped.select(of.alias("stratum"), value.alias("value"), "n", *metrics)


def misses(scores: DataFrame) -> DataFrame:
    """Queries without a hit, and whether the candidates had one."""
    return scores.where("hit = 0").select("query_id", (F.col("ceiling_hit") > 0).alias("in_ceiling"))


def ceiling_gap(scores: DataFrame, limit: float = 0.05) -> DataFrame:
    out = scores.agg(F.round(F.avg("ceiling_hit"), 4).alias("ceiling"), F.round(F.avg("hit"), 4).alias("delivered"), F.round(F.avg(F.col("ceiling_hit") - F.col("hit")), 4).alias("gap"))
    return out.withColumn("rerank_loses", F.col("gap") > limit)


def judge_agreement(pairs: DataFrame, gate: float = 0.8) -> DataFrame:
    """Agreement of graders ``a`` and ``b``; ``a`` is the reference for precision and recall of grades of 1 or more."""
    both = F.sum(((F.col("a") >= 1) & (F.col("b") >= 1)).cast("int"))
    out = pairs.agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 4).alias("exact"),
        F.round(F.avg((F.abs(F.col("a") - F.col("b")) <= 1).cast("double")), 4).alias("within_one"),
        F.round(F.try_divide(both, F.sum((F.col("b") >= 1).cast("int"))), 4).alias("precision"),
        F.round(F.try_divide(both, F.sum((F.col("a") >= 1).cast("int"))), 4).alias("recall"),
    )
    return out.withColumn("passes", F.col("precision") >= gate)


def confusion(pairs: DataFrame, grades: int = 3) -> DataFrame:
    """Counts of every pair of grades, zero cells included."""
    spark = pairs.sparkSession
    cells = spark.range(grades * grades).select((F.col("id") / grades).cast("int").alias("a"), (F.col("id") % grades).cast("int").alias("b"))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    return cells.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# -- distribution helpers: four named conventions ---------------------------------


def upper_median(column: str) -> Column:
    s = F.sort_array(F.collect_list(column))
    return F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)


def nth_share(column: str, share: float) -> Column:
    """The element at ``int(share * n)`` of the sorted values, the last at most."""
    s = F.sort_array(F.collect_list(column))
    return F.element_at(s, (F.least(F.floor(F.size(s) * share), F.size(s) - 1) + 1).cast("int"))


def interpolated_median(column: str) -> Column:
    return F.percentile(column, 0.5)


def sample_stddev(column: str) -> Column:
    return F.coalesce(F.stddev_samp(column), F.lit(0.0))


def pearson(a: str, b: str) -> Column:
    """Correlation, 0 where either has no spread."""
    return F.coalesce(F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)), F.lit(0.0))


def score_gaps(hits: DataFrame) -> DataFrame:
    """Gap of each hit (query_id, id, score, rank) to the next."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("gap", F.round(F.col("score") - F.lead("score").over(order), 6)).where("gap is not null").select("query_id", "rank", "gap")


def gap_cutoffs(gaps: DataFrame, multiples: list[float] = [1.0, 1.5, 2.0, 2.5, 3.0]) -> DataFrame:
    """First rank of each query whose gap exceeds a multiple of the upper median gap, else the number of hits."""
    spark = gaps.sparkSession
    by = gaps.groupBy("query_id").agg(upper_median("gap").alias("m"), F.max("rank").alias("last"))
    levels = spark.createDataFrame([(m,) for m in multiples], "multiple double")
    at = gaps.join(by, "query_id").crossJoin(F.broadcast(levels))
    return at.groupBy("query_id", "multiple").agg(F.coalesce(F.min(F.when(F.col("gap") > F.col("multiple") * F.col("m"), F.col("rank"))), F.max("last") + 1).alias("cut"))


def floor_counts(hits: DataFrame, floors: list[float]) -> DataFrame:
    return hits.groupBy("query_id").agg(*[F.count_if(F.col("score") >= f).alias(f"n_{i}") for i, f in enumerate(floors)])


# -- paired significance ------------------------------------------------------------


def paired(a: DataFrame, b: DataFrame, metric: str, key: str = "query_id") -> DataFrame:
    """(key, x, y, delta) of two per-query tables; queries of one side only are left out."""
    return a.select(key, F.col(metric).alias("x")).join(b.select(key, F.col(metric).alias("y")), key).withColumn("delta", F.col("y") - F.col("x"))


def unpaired(a: DataFrame, b: DataFrame, key: str = "query_id") -> DataFrame:
    """(n_both, n_a_only, n_b_only): queries of two runs, each counted once."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    return x.join(y, key, "full").agg(F.count_if(F.col("_a") & F.col("_b")).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("n_a_only"), F.count_if(F.col("_a").isNull()).alias("n_b_only"))


def grade_summary(pool: DataFrame) -> DataFrame:
    """(stat, value) of graded candidates (query_id, grade, gold): rows of each grade, mean positives a query, and the share of queries that gained a positive beside gold."""
    counts = pool.groupBy("grade").agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit("grade "), F.col("grade").cast("string")).alias("stat"), "value")
    by = pool.groupBy("query_id").agg(F.count_if(F.col("grade") >= 1).alias("n"), F.count_if((F.col("grade") >= 1) & ~F.col("gold")).alias("more"))
    rest = by.agg(F.round(F.avg("n"), 6).alias("m"), F.round(100.0 * F.count_if(F.col("more") > 0) / F.greatest(F.count("*"), F.lit(1)), 6).alias("g"))
    stats = F.explode(F.array(F.struct(F.lit("mean positives").alias("stat"), F.col("m").alias("value")), F.struct(F.lit("gained %").alias("stat"), F.col("g").alias("value"))))
    return counts.unionByName(rest.select(stats.alias("s")).select("s.stat", "s.value"))


def rank_moves(ranks: DataFrame, near: int = 15, far: int = 25) -> DataFrame:
    """Tallies of (before, after) ranks: first ranks up to ``near`` and beyond ``far``, and how many a reranking helped or hurt."""
    return ranks.agg(F.count("*").alias("n"), F.count_if(F.col("before") <= near).alias("near"), F.count_if(F.col("before") > far).alias("far"), F.count_if(F.col("after") < F.col("before")).alias("helped"), F.count_if(F.col("after") > F.col("before")).alias("hurt"))


def score_at(hits: DataFrame, rank: int = K) -> DataFrame:
    """(query_id, score) at a rank; the last hit's where a query has fewer."""
    return hits.where(F.col("rank") <= rank).groupBy("query_id").agg(F.max_by("score", "rank").alias("score"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    n = F.count("*")
    return pairs.agg(n.alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(sample_stddev("delta"), 6).alias("sd_delta"), F.round(pearson("x", "y"), 6).alias("rho"), F.round(2.802 * sample_stddev("delta") / F.sqrt(n), 6).alias("mde"))


def sign_counts(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_if(F.col("delta") > 0).alias("plus"), F.count_if(F.col("delta") < 0).alias("minus"), F.count_if(F.col("delta") == 0).alias("zero"))


def wilcoxon_sums(pairs: DataFrame) -> DataFrame:
    """(n, w_plus, w_minus, z): signed ranks with averaged ties, continuity corrected, without a tie term."""
    moved = pairs.where("delta <> 0").withColumn("size", F.round(F.abs("delta"), 9))
    sizes = moved.groupBy("size").agg(F.count("*").alias("ties"))
    # ranks come from the distinct sizes: a running count over them
    before = F.coalesce(F.sum("ties").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = sizes.withColumn("rank", before + (F.col("ties") + 1) / 2).select("size", "rank")
    sums = moved.join(ranks, "size").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("rank"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("delta") < 0, F.col("rank"))), F.lit(0.0)).alias("w_minus"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)
    z = (F.greatest(F.abs(F.least("w_plus", "w_minus") - n * (n + 1) / 4.0) - 0.5, F.lit(0.0))) / F.when(spread > 0, spread)
    return sums.withColumn("z", F.round(F.coalesce(z, F.lit(0.0)), 6))


def sign_test(plus: int, minus: int) -> float:
    """Exact two-sided p value, 1 at most."""
    n = plus + minus
    if not n:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(plus, minus) + 1))
    return min(1.0, 2 * tail / 2**n)


def normal_two_sided(z: float) -> float:
    return 1 - math.erf(abs(z) / math.sqrt(2))


def bootstrap_ci(pairs: DataFrame, column: str = "delta", resamples: int = 10_000, seed: int = 42, key: str = "query_id") -> DataFrame:
    """Percentile interval of the mean of a column, by replay of one generator; a per-query table is small and goes to one task."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values("k")["v"].tolist()
        rng, n = random.Random(seed), len(values)
        means = sorted(sum(rng.choices(values, k=n)) / n for _ in range(resamples))
        return pd.DataFrame([(n, sum(values) / n, means[int(0.025 * resamples)], means[int(0.975 * resamples)])], columns=["n", "mean", "low", "high"])

    rows = pairs.select(F.lit(0).alias("g"), F.col(key).alias("k"), F.col(column).alias("v"))
    return rows.groupBy("g").applyInPandas(run, "n long, mean double, low double, high double")


def verdict(low: float, high: float, p_values: list[float]) -> bool:
    """The interval excludes 0 and the least p value is under 0.05."""
    return (low > 0 or high < 0) and min(p_values) < 0.05


def mde_table(spark, sd: float, n: int, rhos: list[float]) -> DataFrame:
    """Minimum detectable effect at 80 % power by correlation of the pairs."""
    rows = spark.createDataFrame([(r,) for r in rhos], "rho double")
    spread = F.lit(float(sd)) * F.sqrt(2 * (1 - F.col("rho")))
    return rows.select("rho", F.round(spread, 4).alias("sd_delta"), F.round(2.802 * spread / math.sqrt(n), 4).alias("mde"))


def latency(call: Callable, inputs: Iterable, warm: int = 1) -> dict[str, float]:
    """Median, mean and 90th percentile of the milliseconds that calls take, one after another; the first ``warm`` inputs are called once before."""
    inputs = list(inputs)
    for value in inputs[:warm]:
        call(value)
    taken = []
    for value in inputs:
        start = time.perf_counter()
        call(value)
        taken.append((time.perf_counter() - start) * 1000)
    if not taken:
        return {"n": 0}
    taken.sort()
    return {"n": len(taken), "median": round(statistics.median(taken), 1), "mean": round(statistics.mean(taken), 1), "p90": round(taken[min(len(taken) - 1, int(0.9 * len(taken)))], 1)}


def extractor_table(extractors: dict[str, Callable[[bytes], str]], content: bytes, first: int = 5) -> list[dict]:
    """For each extractor of a document's markdown the seconds it took, its headings by level and the first of them; one that fails has an ``error``."""
    out = []
    for name, extract in extractors.items():
        start = time.perf_counter()
        try:
            lines = extract(content).split("\n")
        except Exception as error:
            out.append({"name": name, "error": f"{type(error).__name__}: {error}"})
            continue
        seconds = round(time.perf_counter() - start, 3)
        heads = [line for line in lines if re.match(r"#{1,3}\s+\S", line)]
        counts = {f"h{n}": sum(line.startswith("#" * n) and line[n].isspace() for line in heads) for n in (1, 2, 3)}
        out.append({"name": name, "seconds": seconds, **counts, "first": heads[:first]})
    return out
