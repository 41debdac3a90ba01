"""Profiles of numeric columns and reports on runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


_QUARTILES = (0.25, 0.5, 0.75)
#: The share of the rows about a quartile that is looked at for its exact value is four by this.
_ACCURACY = 10_000


def numeric_profile(df: DataFrame, *columns: str) -> DataFrame:
    """(column, stat, value) of STATS. Quartiles are exact and interpolated. Zeros have no sign; nulls don't count.

    Three jobs: bounds that surely hold each quartile, from sketches; counts, means
    and the rows below each bound; then only the values between the bounds, each
    with its count, among which the quartile's place is found. No task gets more of a
    column than that small share."""
    x = {c: F.col(c).cast("double") for c in columns}
    slack = 2 / _ACCURACY
    asked = [min(max(q + d, 0.0), 1.0) for q in _QUARTILES for d in (-slack, slack)]
    bounds = df.agg(*[F.percentile_approx(x[c], F.array(*map(F.lit, asked)), _ACCURACY).alias(c) for c in columns]).first()
    aggs = []
    for c in columns:
        edges = bounds[c] or [None] * 6
        below = [F.struct(F.count_if(x[c] < F.lit(edges[2 * i])).alias("n"), F.max(F.when(x[c] < F.lit(edges[2 * i]), x[c])).alias("before"), F.min(F.when(x[c] > F.lit(edges[2 * i + 1]), x[c])).alias("after")) for i in range(3)]
        aggs.append(F.struct(F.count(x[c]).alias("n"), F.avg(x[c]).alias("mean"), F.stddev_samp(x[c]).alias("std"), F.min(x[c]).alias("min"), F.max(x[c]).alias("max"), F.array(*below).alias("below")).alias(c))
    facts = df.agg(*aggs).first()
    spots, rows = [], []
    for c in columns:
        f = facts[c]
        rows += [(c, "count", float(f["n"])), (c, "mean", f["mean"]), (c, "std", f["std"]), (c, "min", f["min"]), (c, "max", f["max"])]
        for i, q in enumerate(_QUARTILES):
            if bounds[c]:
                low, high = (F.lit(bounds[c][2 * i + k]) for k in (0, 1))
                place = (f["n"] - 1) * q
                spots.append(F.when((x[c] >= low) & (x[c] <= high), F.struct(F.lit(c).alias("column"), F.lit(STATS[4 + i]).alias("stat"), x[c].alias("v"), F.lit(float(place)).alias("place"), F.lit(f["below"][i].n).alias("below"), F.lit(f["below"][i].before).cast("double").alias("before"), F.lit(f["below"][i].after).cast("double").alias("after"))))
            else:
                rows.append((c, STATS[4 + i], None))
    spark = df.sparkSession
    out = spark.createDataFrame(rows, "column string, stat string, value double")
    if spots:
        near = df.select(F.explode(F.filter(F.array(*spots), lambda s: s.isNotNull())).alias("s")).select("s.*").groupBy("column", "stat", "v", "place", "below", "before", "after").agg(F.count(F.lit(1)).alias("n"))
        last = F.col("below") + F.sum("n").over(Window.partitionBy("column", "stat").orderBy("v")) - 1
        held = near.withColumn("last", last).withColumn("first", F.col("last") - F.col("n") + 1)
        # the values at the two whole places about the quartile's, which may be one place beyond the bounds
        at = lambda p: F.max(F.when((F.col("first") <= p) & (F.col("last") >= p), F.col("v")))
        low, high, part = F.coalesce(at(F.floor("place")), F.max("before")), F.coalesce(at(F.ceil("place")), F.max("after")), F.max("place") - F.floor(F.max("place"))
        out = out.union(held.groupBy("column", "stat").agg((low + (high - low) * part).alias("value")))
    return out.withColumn("value", F.col("value") + 0.0)


def run_report(df: DataFrame, by: str, tokens: str = "tokens", sentiment: str | None = None, status: str | None = None, statuses: tuple[str, ...] = ("success", "failed", "skipped")) -> DataFrame:
    """Rows, tokens and mean sentiment by file or source, and how many rows have each status."""
    aggs = [F.count(F.lit(1)).alias("total_sentences"), F.sum(F.size(tokens)).alias("total_tokens")]
    if sentiment:
        aggs.append(F.avg(sentiment).alias("avg_sentiment"))
    if status:
        aggs += [F.count_if(F.col(status) == x).alias(f"n_{x}") for x in statuses]
    return df.groupBy(by).agg(*aggs)
