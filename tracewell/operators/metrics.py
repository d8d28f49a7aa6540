"""How well candidates match exact nearest neighbours, for all settings of a grid at once.

found: (g, bands, width, q, nn, s), the candidates of each query with their similarity, g in grid
order. real: (q, nn, s), all other rows of each query. Values are compared as stored, so both come
from one table of similarities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.hashing import collision

GRID = ("g", "bands", "width")


def scored(candidates: DataFrame, real: DataFrame) -> DataFrame:
    """Candidates other than the query itself, with their similarity."""
    return candidates.where("q <> nn").join(real, ["q", "nn"]).select(*GRID, "q", "nn", "s")


def _p() -> Column:
    return collision(F.col("s"), F.col("bands"), F.col("width"))


def _every(grid: DataFrame, queries: DataFrame) -> DataFrame:
    """All settings for all queries (q)."""
    settings = [F.struct(*(F.lit(r[c]).alias(c) for c in GRID)) for r in grid.select(*GRID).distinct().orderBy("g").collect()]
    return queries.select("q", F.explode(F.array(*settings)).alias("x")).select("x.*", "q")


def exact_neighbours(real: DataFrame, k: int) -> DataFrame:
    """(q, rank, nn, s): the k most similar rows, ties to the smaller nn."""
    w = Window.partitionBy("q").orderBy(F.desc("s"), "nn")
    return real.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "rank", "nn", "s")


def smallest_probability(found: DataFrame, grid: DataFrame, queries: DataFrame) -> DataFrame:
    """(bands, width, q, value): collision probability of the least similar candidate, null without candidates."""
    low = found.groupBy(*GRID, "q").agg(F.min("s").alias("s")).select(*GRID, "q", _p().alias("value"))
    return _every(grid, queries).join(low, [*GRID, "q"], "left").select("bands", "width", "q", "value")


def reciprocal_ranks(found: DataFrame, real: DataFrame, grid: DataFrame, queries: DataFrame) -> DataFrame:
    """(bands, width, q, value): mean over candidates, by rank, of 1 if the rank is beyond its value's first exact rank, else (rank + 1) / (exact rank + 1)."""
    exact = real.select("q", "nn", F.rank().over(Window.partitionBy("q").orderBy(F.desc("s"))).alias("r"))
    ranked = found.withColumn("i", F.row_number().over(Window.partitionBy(*GRID, "q").orderBy(F.desc("s"), "nn"))).join(exact, ["q", "nn"])
    part = F.when(F.col("i") > F.col("r"), 1.0).otherwise((F.col("i") + 1) / (F.col("r") + 1))
    mean = ranked.groupBy(*GRID, "q").agg(F.avg(part).alias("value"))
    return _every(grid, queries).join(mean, [*GRID, "q"], "left").select("bands", "width", "q", "value")


def precision(found: DataFrame, grid: DataFrame, queries: DataFrame) -> DataFrame:
    """(bands, width, q, value): share of candidates with a collision probability of a half or more, null without candidates."""
    share = found.groupBy(*GRID, "q").agg(F.avg(F.when(_p() >= 0.5, 1.0).otherwise(0.0)).alias("value"))
    return _every(grid, queries).join(share, [*GRID, "q"], "left").select("bands", "width", "q", "value")


def recall(found: DataFrame, real: DataFrame, grid: DataFrame, queries: DataFrame) -> DataFrame:
    """(bands, width, q, value): found over all rows with a collision probability of a half or more, null if there are none."""
    likely = F.count(F.when(_p() >= 0.5, 1))
    got = found.groupBy(*GRID, "q").agg(likely.alias("got"))
    settings = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in GRID)) for r in grid.select(*GRID).distinct().orderBy("g").collect()))
    there = real.select("q", "s", F.explode(settings).alias("x")).select("x.*", "q", "s").groupBy(*GRID, "q").agg(likely.alias("there"))
    both = _every(grid, queries).join(there, [*GRID, "q"], "left").join(got, [*GRID, "q"], "left")
    return both.select("bands", "width", "q", F.try_divide(F.coalesce("got", F.lit(0)).cast("double"), F.col("there").cast("double")).alias("value"))


def f_score(precisions: DataFrame, recalls: DataFrame) -> DataFrame:
    """(bands, width, q, value): 0 if either is 0, else the harmonic mean; null where one is null."""
    both = precisions.withColumnRenamed("value", "p").join(recalls.withColumnRenamed("value", "r"), ["bands", "width", "q"])
    value = F.when((F.col("p") == 0) | (F.col("r") == 0), 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return both.select("bands", "width", "q", value.alias("value"))


def _hits(found: DataFrame, real: DataFrame, k: int) -> DataFrame:
    top = found.withColumn("i", F.row_number().over(Window.partitionBy(*GRID, "q").orderBy(F.desc("s"), "nn"))).withColumn("many", F.count("*").over(Window.partitionBy(*GRID, "q")))
    return hits(top, exact_neighbours(real, k), k)


def hits(top: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """(g, bands, width, q, score) of queries with k candidates or more: share of the k largest exact values among the k largest found, as multisets.

    top: (g, bands, width, q, nn, s, i, many), candidates with their places and how many a query has; best: (q, rank, nn, s). Both may hold more than k.
    """
    top, best = top.where((F.col("many") >= k) & (F.col("i") <= k)), best.where(F.col("rank") <= k)
    occurrence = lambda *by: F.row_number().over(Window.partitionBy(*by, "q", "s").orderBy("nn"))
    mine = top.withColumn("o", occurrence(*GRID))
    theirs = best.select("q", "s", occurrence().alias("o"))
    both = mine.join(theirs.withColumn("_hit", F.lit(1)), ["q", "s", "o"], "left")
    return both.groupBy(*GRID, "q").agg((F.count("_hit") / k).alias("score"))


def recall_at_k(found: DataFrame, real: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    return recall_of_hits(_hits(found, real, k), grid, k)


def recall_of_hits(scores: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    """(bands, width, k, queries, recall): mean score of the queries with k candidates or more at each setting; null without any."""
    per = scores.groupBy(*GRID).agg(F.count("*").alias("queries"), F.avg("score").alias("recall"))
    return grid.select(*GRID).distinct().join(per, list(GRID), "left").select("bands", "width", F.lit(k).alias("k"), F.coalesce("queries", F.lit(0)).cast("long").alias("queries"), "recall")


def cascaded_recall_at_k(found: DataFrame, real: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return cascade_of_hits(_hits(found, real, k), queries, k)


def cascade_of_hits(scores: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(k, recall): each query counts at the first setting that gives it k candidates or more, and as 0 if none does."""
    first = scores.groupBy("q").agg(F.min(F.struct("g", "score")).alias("m")).select("q", F.col("m.score").alias("score"))
    return queries.join(first, "q", "left").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("recall")).select(F.lit(k).alias("k"), "recall")


# ---- from counts of every query and setting (bands, width, q, many, low, got, there)


def smallest_of_counts(counts: DataFrame) -> DataFrame:
    return counts.select("bands", "width", "q", collision(F.col("low"), F.col("bands"), F.col("width")).alias("value"))


def precision_of_counts(counts: DataFrame) -> DataFrame:
    return counts.select("bands", "width", "q", F.try_divide(F.col("got").cast("double"), F.col("many").cast("double")).alias("value"))


def recall_of_counts(counts: DataFrame) -> DataFrame:
    return counts.select("bands", "width", "q", F.try_divide(F.col("got").cast("double"), F.col("there").cast("double")).alias("value"))


def summary(values: DataFrame) -> DataFrame:
    """(bands, width, mean, low, quarter, half, three_quarters, high) of a metric (bands, width, q, value), without nulls."""
    p = F.percentile("value", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    out = values.where(F.col("value").isNotNull()).groupBy("bands", "width").agg(F.avg("value").alias("mean"), p.alias("p"))
    return out.select("bands", "width", "mean", *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("low", "quarter", "half", "three_quarters", "high"))))
