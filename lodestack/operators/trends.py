"""Frequency of keywords over years: counts, trends, bursts, life cycles, forecasts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def yearly_frequency(signals: DataFrame, doc: str = "doc_id", keyword: str = "keyword", year: str = "year") -> DataFrame:
    """``keyword, year, count, normalized_df``: distinct documents, and their share of the year's documents."""
    totals = signals.groupBy(year).agg(F.count_distinct(doc).alias("total"))
    counts = signals.groupBy(keyword, year).agg(F.count_distinct(doc).alias("count"))
    return counts.join(totals, year).select(keyword, year, "count", F.round(F.col("count") / F.col("total"), 6).alias("normalized_df"))


def spine(frequency: DataFrame, start: int, end: int, keyword: str = "keyword", year: str = "year") -> DataFrame:
    """One row for each keyword and year of the window, 0 where nothing was counted."""
    inside = frequency.where(F.col(year).between(start, end))
    years = F.explode(F.sequence(F.lit(start), F.lit(end))).alias(year)
    grid = inside.select(keyword).distinct().select(keyword, years)
    filled = grid.join(inside, [keyword, year], "left")
    return filled.select(keyword, year, F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("normalized_df", F.lit(0.0)).alias("normalized_df"))


def trend_rows(grid: DataFrame, start: int, end: int, keyword: str = "keyword", year: str = "year") -> DataFrame:
    """Growth, burst and momentum of each keyword; ``end`` is the partial year."""
    share = lambda y: F.sum(F.when(F.col(year) == y, F.col("normalized_df")).otherwise(0.0))
    wide = grid.groupBy(keyword).agg(
        F.sum("count").alias("doc_count"), ((share(start) + share(start + 1)) / 2).alias("base"), share(end - 1).alias("current"),
        F.max("normalized_df").alias("top"), (F.sum("normalized_df") / (end - start + 1)).alias("mean"),
        *[F.round(share(y), 6).alias(f"normalized_df_{y}") for y in range(start, end + 1)],
    )
    growth = F.when(F.col("base") > 0, (F.col("current") - F.col("base")) / F.col("base")).otherwise(F.col("current"))
    burst = F.when(F.col("mean") > 0, F.col("top") / F.col("mean")).otherwise(0.0)
    return wide.select(
        keyword, "doc_count", F.round(growth, 6).alias("growth_rate"), F.round(burst, 6).alias("burst_score"),
        F.round(F.log1p("doc_count") * (growth + F.col("current")), 6).alias("momentum"), *[f"normalized_df_{y}" for y in range(start, end + 1)],
    )


def burst_rows(grid: DataFrame, keyword: str = "keyword", year: str = "year", step: float = 0.3) -> DataFrame:
    """Years in which a keyword emerges, grows or declines by ``step`` or more against the year before."""
    before = Window.partitionBy(keyword).orderBy(year)
    c, p = F.col("count"), F.col("previous_count")
    growth = F.when(p == 0, c.cast("double")).otherwise((c - p) / F.greatest(p, F.lit(1)))
    state = F.when((c > 0) & (p == 0), "emergence").when(growth >= step, "growth").when(growth <= -step, "decline")
    rows = grid.withColumn("previous_count", F.coalesce(F.lag("count").over(before), F.lit(0))).where("count > 0 or previous_count > 0")
    return rows.select(
        keyword, year, "count", "previous_count", F.round(growth, 6).alias("growth_rate"),
        F.round(F.log1p(c + p) * F.abs(growth), 6).alias("burst_score"), state.alias("burst_state"),
    ).where("burst_state is not null")


def lifecycle(grid: DataFrame, trends: DataFrame, start: int, end: int, keyword: str = "keyword", year: str = "year") -> DataFrame:
    """First, peak (the earliest of equals) and last year, and the stage by rules in their order."""
    seen = F.when(F.col("count") > 0, F.col(year))
    rows = grid.groupBy(keyword).agg(
        F.sum("count").alias("doc_count"), F.min(seen).alias("first_year"), F.max_by(year, F.struct("count", -F.col(year))).alias("peak_year"),
        F.max(seen).alias("last_year"), F.max("count").alias("peak_count"), F.sum(F.when(F.col(year) == end, F.col("count")).otherwise(0)).alias("last_count"),
    )
    rows = rows.join(trends.select(keyword, "growth_rate", "burst_score"), keyword, "left").where("doc_count > 0")
    growth = F.coalesce("growth_rate", F.lit(0.0))
    stage = (
        F.when(F.col("first_year") >= end - 1, "emergence")
        .when((growth >= 0.3) | ((F.col("first_year") > start) & (F.col("peak_year") >= end - 1)), "growth")
        .when((F.col("peak_year") < end - 1) & (F.col("last_count") < F.col("peak_count")), "decline")
        .otherwise("maturity")
    )
    return rows.select(keyword, stage.alias("lifecycle_stage"), "doc_count", "first_year", "peak_year", "last_year", "peak_count", growth.alias("growth_rate"))


def _pairs(values: Column, f) -> Column:
    """f(i, j, x_i, x_j) over all i < j, as one array."""
    n = F.size(values)
    inner = lambda x, i: F.transform(F.slice(values, i + 2, n), lambda y, k: f(i, i + 1 + k, x, y))
    return F.flatten(F.transform(values, inner))


def mann_kendall(series: DataFrame, keyword: str = "keyword", values: str = "values") -> DataFrame:
    """Adds ``mk_s, mk_tau, mk_z, sen_slope`` of an array column; series under three values show no trend."""
    v = F.col(values)
    n = F.size(v).cast("double")
    s = F.aggregate(_pairs(v, lambda i, j, x, y: F.signum(y - x)), F.lit(0.0), lambda a, b: a + b)
    slopes = F.array_sort(_pairs(v, lambda i, j, x, y: (y - x) / (j - i)))
    spread = F.sqrt(n * (n - 1) * (2 * n + 5) / 18.0)
    rows = series.withColumn("mk_s", F.when(n >= 3, s).otherwise(0.0)).withColumn("slopes", slopes)
    m = F.size("slopes")
    middle = (F.get("slopes", F.floor((m - 1) / 2).cast("int")) + F.get("slopes", F.floor(m / 2).cast("int"))) / 2
    z = F.when(F.col("mk_s") > 0, (F.col("mk_s") - 1) / spread).when(F.col("mk_s") < 0, (F.col("mk_s") + 1) / spread).otherwise(0.0)
    return rows.select(
        *series.columns, "mk_s", F.round(F.when(n >= 3, F.col("mk_s") / (0.5 * n * (n - 1))).otherwise(0.0), 4).alias("mk_tau"),
        F.round(F.when(n >= 3, z).otherwise(0.0), 6).alias("mk_z"), F.round(F.when(n >= 3, middle).otherwise(0.0), 8).alias("sen_slope"),
    )


def with_p_value(rows: DataFrame) -> DataFrame:
    """Adds the two-sided normal p-value of ``mk_z`` and the trend's name.

    The complementary error function is taken by its rational approximation of error under 1.5e-7.
    """
    x = F.abs("mk_z") / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    p = F.when(F.col("mk_z") == 0, 1.0).otherwise(poly * F.exp(-x * x))
    sure = p < 0.1
    name = (
        F.when(sure & (F.col("mk_s") > 0), "increasing").when(sure & (F.col("mk_s") < 0), "decreasing")
        .when(F.col("sen_slope") > 0, "rising").when(F.col("sen_slope") < 0, "falling").otherwise("no-trend")
    )
    return rows.withColumn("mk_p", F.round(p, 4)).withColumn("mk_trend", name)


def forecast(grid: DataFrame, last_fit: int, keyword: str = "keyword", year: str = "year", value: str = "normalized_df", damping: float = 0.5) -> DataFrame:
    """Damped next-year forecast with band, from the years up to ``last_fit``.

    The last value moves by half the median pairwise slope (the least-squares slope where that is 0);
    the band is 1.96 residual standard errors; a flat series stays where it is.
    """
    fit = grid.where(F.col(year) <= last_fit)
    x, y = F.col(year).cast("double"), F.col(value)
    rows = fit.groupBy(keyword).agg(
        F.array_sort(F.collect_list(F.struct(year, value))).alias("points"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_sxx(y, x).alias("sxx"), F.count("*").alias("n"), F.max(year).alias("last"),
        F.min(y).alias("least"), F.max(y).alias("most"),
    )
    rows = mann_kendall(rows.withColumn("values", F.col(f"points.{value}")), keyword)
    flat = (F.col("n") < 2) | (F.col("most") - F.col("least") <= 1e-8 + 1e-5 * F.abs(F.get("values", F.lit(0))))
    rest = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    sen = F.when(F.col("sen_slope") != 0, F.col("sen_slope")).otherwise(F.col("slope"))
    end = F.element_at("values", -1)
    point = F.when(flat, end).otherwise(end + damping * sen)
    margin = F.when(flat, 0.0).otherwise(1.96 * F.sqrt(rest / F.greatest(F.col("n") - 2, F.lit(1))))
    r2 = F.when(flat, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - rest / F.when(F.col("syy") > 0, F.col("syy")).otherwise(1e-12)))
    return rows.select(
        keyword, F.round(F.when(flat, 0.0).otherwise(F.col("slope")), 8).alias("slope"), F.round(r2, 4).alias("r2"),
        F.greatest(F.lit(0.0), F.round(point, 6)).alias("forecast"), F.greatest(F.lit(0.0), F.round(point - margin, 6)).alias("low"),
        F.round(point + margin, 6).alias("high"), "mk_s", "mk_tau", "mk_z", "sen_slope",
    )


def context_drift(pairs: DataFrame, top: DataFrame, keyword: str = "keyword", year: str = "year") -> DataFrame:
    """1 - cosine of a keyword's co-keyword counts in consecutive years, for the keywords of ``top``."""
    directed = pairs.select(F.col("a").alias("k"), F.col("b").alias("o"), year).union(pairs.select(F.col("b").alias("k"), F.col("a").alias("o"), year))
    counts = directed.join(top.select(F.col(keyword).alias("k")), "k", "left_semi").groupBy("k", "o", year).agg(F.count("*").alias("c"))
    norms = counts.groupBy("k", year).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    after = counts.select("k", "o", (F.col(year) - 1).alias(year), F.col("c").alias("d"))
    dots = counts.join(after, ["k", "o", year]).groupBy("k", year).agg(F.sum(F.col("c") * F.col("d")).alias("dot"))
    both = norms.join(norms.select("k", (F.col(year) - 1).alias(year), F.col("norm").alias("norm2")), ["k", year]).join(dots, ["k", year], "left")
    cosine = F.coalesce("dot", F.lit(0)) / (F.col("norm") * F.col("norm2"))
    return both.select(F.col("k").alias(keyword), F.col(year).alias("from_year"), (F.col(year) + 1).alias("to_year"), F.round(1 - cosine, 6).alias("drift"))


def min_max(column: str) -> Column:
    low, high = F.col(f"{column}_low"), F.col(f"{column}_high")
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.0)


def hotness(rows: DataFrame) -> DataFrame:
    """Adds 0.5 momentum + 0.3 burst + 0.2 slope, each scaled to 0..1 over all rows."""
    names = ["momentum", "burst_score", "sen_slope"]
    ends = rows.agg(*[f(n).alias(f"{n}_{e}") for n in names for f, e in ((F.min, "low"), (F.max, "high"))])
    joined = rows.crossJoin(F.broadcast(ends))  # one row
    score = 0.5 * min_max("momentum") + 0.3 * min_max("burst_score") + 0.2 * min_max("sen_slope")
    return joined.select(*rows.columns, F.round(score, 6).alias("hotness"))
