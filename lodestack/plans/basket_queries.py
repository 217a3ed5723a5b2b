"""Queries over order baskets as documents: co-occurrence, trends, authors, dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cooccurrence as co
from ..operators import trends as tr
from ..sources import records
from ..storage import dealt
from . import roles
from .roles import BASKETS_SQL, YEAR_END, YEAR_START

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
W = f"WITH {BASKETS_SQL}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


PAIRS = """, sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM doc_keywords),
pairs AS (SELECT x.doc_id, x.keyword AS a, y.keyword AS b, x.year, x.n FROM sized x JOIN sized y ON x.doc_id = y.doc_id AND x.keyword < y.keyword)"""
AUTHOR_PAIRS = """, asized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM doc_authors),
apairs AS (SELECT x.doc_id, x.author AS a, y.author AS b, x.year, x.n FROM asized x JOIN asized y ON x.doc_id = y.doc_id AND x.author < y.author)"""
EDGES = """, edges AS (SELECT a, b, round(sum(2.0 / (n * (n - 1))), 6) AS weight, count(*) AS paper_count, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS active_years FROM pairs GROUP BY a, b)"""


def keyword_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.document_pairs(roles.doc_keywords(spark, sf_dir), "doc_id", "keyword", "year")


def author_pairs(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Few of them are equal, so they are dealt out before they are summed."""
    pairs = co.document_pairs(roles.doc_authors(spark, sf_dir), "doc_id", "author", "year", **options)
    return dealt(pairs, 2 * roles.size(spark, sf_dir), "a", "b")


def keyword_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.weighted_edges(keyword_pairs(spark, sf_dir), "doc_id", "year")


@query("agg13_cooccurrence_edges", W + PAIRS + EDGES + "SELECT * FROM edges")
def agg13(spark, sf_dir):
    return keyword_edges(spark, sf_dir)


@query("joi07_document_pairs", W + PAIRS + "SELECT a, b, year, count(*) AS n_docs FROM pairs GROUP BY ALL")
def joi07(spark, sf_dir):
    return keyword_pairs(spark, sf_dir).groupBy("a", "b", "year").agg(F.count("*").alias("n_docs"))


@query("top03_heaviest_edges", W + PAIRS + EDGES + "SELECT * FROM edges ORDER BY weight DESC, a, b LIMIT 140")
def top03(spark, sf_dir):
    return co.top_edges(keyword_edges(spark, sf_dir), 140)


@query("agg14_coauthor_counts", W + AUTHOR_PAIRS + "SELECT a, b, count(*) AS weight FROM apairs GROUP BY a, b")
def agg14(spark, sf_dir):
    return author_pairs(spark, sf_dir).groupBy("a", "b").agg(F.count("*").alias("weight"))


@query(
    "agg15_coauthor_weights",
    W + AUTHOR_PAIRS + """SELECT a, b, CAST(count(*) AS DOUBLE) AS full_weight, round(sum(2.0 / (n * (n - 1))), 6) AS pair_weight, round(sum(1.0 / (n - 1)), 6) AS author_weight,
    count(*) AS paper_count, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS active_years, count(*) FILTER (n > 12) AS long_papers FROM apairs GROUP BY a, b""",
)
def agg15(spark, sf_dir):
    return co.author_edges(author_pairs(spark, sf_dir), "year")


@query("agg16_serving_edges", W + AUTHOR_PAIRS + "SELECT a, b, count(*) AS weight, min(year) AS first_year, max(year) AS last_year FROM apairs WHERE n <= 50 GROUP BY a, b")
def agg16(spark, sf_dir):
    return author_pairs(spark, sf_dir, max_items=50).groupBy("a", "b").agg(F.count("*").alias("weight"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("agg17_report_edges", W + AUTHOR_PAIRS + "SELECT a, b, round(sum(1.0 / sqrt(n - 1)), 6) AS weight, count(*) AS paper_count FROM apairs WHERE n <= 12 GROUP BY a, b")
def agg17(spark, sf_dir):
    return author_pairs(spark, sf_dir, max_items=12).groupBy("a", "b").agg(F.round(F.sum(co.WEIGHTS["root"](F.col("n"))), 6).alias("weight"), F.count("*").alias("paper_count"))


@query(
    "agg17_author_scope",
    W + """, s AS (SELECT doc_id, count(*) AS n FROM doc_authors GROUP BY doc_id)
    SELECT count(*) FILTER (n BETWEEN 2 AND 12) AS valid, count(*) FILTER (n > 12) AS skipped, count(*) FILTER (n < 2) AS no_pair FROM s""",
)
def agg17_scope(spark, sf_dir):
    sizes = roles.doc_authors(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count_if(F.col("n").between(2, 12)).alias("valid"), F.count_if(F.col("n") > 12).alias("skipped"), F.count_if(F.col("n") < 2).alias("no_pair"))


# ---- trends

FREQ = f""", totals AS (SELECT year, count(DISTINCT doc_id) AS total FROM doc_keywords GROUP BY year),
freq AS (SELECT keyword, k.year, count(DISTINCT doc_id) AS count, round(count(DISTINCT doc_id) / max(total), 6) AS normalized_df FROM doc_keywords k JOIN totals t ON k.year = t.year GROUP BY keyword, k.year),
grid AS (SELECT g.keyword, g.year, coalesce(f.count, 0) AS count, coalesce(f.normalized_df, 0.0) AS normalized_df
  FROM (SELECT k.keyword, CAST(y AS INTEGER) AS year FROM (SELECT DISTINCT keyword FROM freq WHERE year BETWEEN {YEAR_START} AND {YEAR_END}) k, range({YEAR_START}, {YEAR_END + 1}) r(y)) g
  LEFT JOIN freq f ON f.keyword = g.keyword AND f.year = g.year)"""
_Y = range(YEAR_START, YEAR_END + 1)
TRENDS = f""", wide AS (SELECT keyword, CAST(sum(count) AS BIGINT) AS doc_count,
  (sum(normalized_df) FILTER (year = {YEAR_START}) + sum(normalized_df) FILTER (year = {YEAR_START + 1})) / 2 AS base, sum(normalized_df) FILTER (year = {YEAR_END - 1}) AS current,
  max(normalized_df) AS top, sum(normalized_df) / {len(_Y)} AS mean, {', '.join(f'round(sum(normalized_df) FILTER (year = {y}), 6) AS normalized_df_{y}' for y in _Y)} FROM grid GROUP BY keyword),
trends AS (SELECT keyword, doc_count, round(CASE WHEN base > 0 THEN (current - base) / base ELSE current END, 6) AS growth_rate, round(CASE WHEN mean > 0 THEN top / mean ELSE 0 END, 6) AS burst_score,
  round(ln(1 + doc_count) * (CASE WHEN base > 0 THEN (current - base) / base ELSE current END + current), 6) AS momentum, {', '.join(f'normalized_df_{y}' for y in _Y)} FROM wide)"""
BURSTS = """, lagged AS (SELECT *, coalesce(lag(count) OVER (PARTITION BY keyword ORDER BY year), 0) AS previous_count FROM grid),
grown AS (SELECT *, CASE WHEN previous_count = 0 THEN CAST(count AS DOUBLE) ELSE (count - previous_count) / greatest(previous_count, 1) END AS g FROM lagged WHERE count > 0 OR previous_count > 0),
bursts AS (SELECT keyword, year, count, previous_count, round(g, 6) AS growth_rate, round(ln(1 + count + previous_count) * abs(g), 6) AS burst_score,
  CASE WHEN count > 0 AND previous_count = 0 THEN 'emergence' WHEN g >= 0.3 THEN 'growth' WHEN g <= -0.3 THEN 'decline' END AS burst_state FROM grown)"""
LIFE = f""", life0 AS (SELECT keyword, CAST(sum(count) AS BIGINT) AS doc_count, min(year) FILTER (count > 0) AS first_year, arg_max(year, count * 10000 - year) AS peak_year,
  max(year) FILTER (count > 0) AS last_year, max(count) AS peak_count, sum(count) FILTER (year = {YEAR_END}) AS last_count FROM grid GROUP BY keyword),
life AS (SELECT l.keyword, CASE WHEN first_year >= {YEAR_END - 1} THEN 'emergence' WHEN coalesce(growth_rate, 0) >= 0.3 OR (first_year > {YEAR_START} AND peak_year >= {YEAR_END - 1}) THEN 'growth'
  WHEN peak_year < {YEAR_END - 1} AND last_count < peak_count THEN 'decline' ELSE 'maturity' END AS lifecycle_stage, l.doc_count, first_year, peak_year, last_year, peak_count, coalesce(growth_rate, 0.0) AS growth_rate
  FROM life0 l LEFT JOIN trends t ON l.keyword = t.keyword WHERE l.doc_count > 0)"""


def grid(spark, sf_dir):
    return tr.spine(tr.yearly_frequency(roles.doc_keywords(spark, sf_dir)), YEAR_START, YEAR_END)


def trends(spark, sf_dir):
    return tr.trend_rows(grid(spark, sf_dir), YEAR_START, YEAR_END)


@query("agg12_yearly_frequency", W + FREQ + "SELECT * FROM freq")
def agg12(spark, sf_dir):
    return tr.yearly_frequency(roles.doc_keywords(spark, sf_dir))


@query("win04_trend_rows", W + FREQ + TRENDS + "SELECT * FROM trends")
def win04(spark, sf_dir):
    return trends(spark, sf_dir)


@query("win02_bursts", W + FREQ + BURSTS + "SELECT * FROM bursts WHERE burst_state IS NOT NULL")
def win02(spark, sf_dir):
    return tr.burst_rows(grid(spark, sf_dir))


@query("win03_lifecycle", W + FREQ + TRENDS + LIFE + "SELECT * FROM life")
def win03(spark, sf_dir):
    return tr.lifecycle(grid(spark, sf_dir), trends(spark, sf_dir), YEAR_START, YEAR_END)


@query(
    "win05_representative",
    W + f"""SELECT keyword, coalesce(max(doc_id) FILTER (year BETWEEN {YEAR_START} AND {YEAR_END}), min(doc_id)) AS representative FROM doc_keywords GROUP BY keyword""",
)
def win05(spark, sf_dir):
    docs = roles.doc_keywords(spark, sf_dir)
    recent = F.when(F.col("year").between(YEAR_START, YEAR_END), F.col("doc_id"))
    return docs.groupBy("keyword").agg(F.coalesce(F.max(recent), F.min("doc_id")).alias("representative"))


@query(
    "win06_context_drift",
    W + PAIRS + f""", top AS (SELECT keyword FROM doc_keywords GROUP BY keyword ORDER BY count(*) DESC, keyword LIMIT 20),
    d AS (SELECT k, o, year, count(*) AS c FROM (SELECT a AS k, b AS o, year FROM pairs UNION ALL SELECT b, a, year FROM pairs) WHERE k IN (SELECT keyword FROM top) GROUP BY ALL),
    nn AS (SELECT k, year, sqrt(sum(c * c)) AS norm FROM d GROUP BY ALL), dd AS (SELECT x.k, x.year, sum(x.c * y.c) AS dot FROM d x JOIN d y ON x.k = y.k AND x.o = y.o AND y.year = x.year + 1 GROUP BY ALL)
    SELECT n.k AS keyword, n.year AS from_year, n.year + 1 AS to_year, round(1 - coalesce(dot, 0) / (n.norm * m.norm), 6) AS drift FROM nn n JOIN nn m ON n.k = m.k AND m.year = n.year + 1 LEFT JOIN dd ON dd.k = n.k AND dd.year = n.year""",
)
def win06(spark, sf_dir):
    docs = roles.doc_keywords(spark, sf_dir)
    top = docs.groupBy("keyword").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "keyword").limit(20)
    return tr.context_drift(keyword_pairs(spark, sf_dir), top)


MK = f""", s AS (SELECT keyword, list(normalized_df ORDER BY year) AS v, count(*) AS n FROM grid WHERE year <= {YEAR_END - 1} GROUP BY keyword),
p AS (SELECT keyword, n, sum(sign(v[j] - v[i])) AS mk_s, median((v[j] - v[i]) / (j - i)) AS sen FROM s, range(1, n + 1) a(i), range(1, n + 1) b(j) WHERE i < j GROUP BY keyword, n),
mk AS (SELECT keyword, CAST(mk_s AS DOUBLE) AS mk_s, round(mk_s / (0.5 * n * (n - 1)), 4) AS mk_tau,
  round(CASE WHEN mk_s > 0 THEN (mk_s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) WHEN mk_s < 0 THEN (mk_s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) ELSE 0 END, 6) AS mk_z, round(sen, 8) AS sen_slope FROM p)"""


@query("win07_mann_kendall", W + FREQ + MK + "SELECT * FROM mk")
def win07(spark, sf_dir):
    rows = grid(spark, sf_dir).where(F.col("year") <= YEAR_END - 1).groupBy("keyword").agg(F.array_sort(F.collect_list(F.struct("year", "normalized_df"))).alias("p"))
    return tr.mann_kendall(rows.select("keyword", F.col("p.normalized_df").alias("values"))).drop("values")


@query("win07_trend_names")
def win07_names(spark, sf_dir):
    return tr.with_p_value(win07(spark, sf_dir))


FORECAST = MK + f""", o AS (SELECT keyword, regr_slope(normalized_df, year) AS slope, regr_syy(normalized_df, year) AS syy, regr_sxy(normalized_df, year) AS sxy, regr_sxx(normalized_df, year) AS sxx, count(*) AS n,
  arg_max(normalized_df, year) AS last, max(normalized_df) - min(normalized_df) <= 1e-8 + 1e-5 * abs(arg_min(normalized_df, year)) AS flat FROM grid WHERE year <= {YEAR_END - 1} GROUP BY keyword),
fc0 AS (SELECT o.*, mk.* EXCLUDE keyword, greatest(syy - sxy * sxy / sxx, 0) AS rest, last + 0.5 * CASE WHEN sen_slope <> 0 THEN sen_slope ELSE slope END AS point FROM o JOIN mk ON o.keyword = mk.keyword),
fc AS (SELECT keyword, round(CASE WHEN flat THEN 0 ELSE slope END, 8) AS slope, round(CASE WHEN flat THEN 0 ELSE greatest(0, 1 - rest / CASE WHEN syy > 0 THEN syy ELSE 1e-12 END) END, 4) AS r2,
  greatest(0, round(CASE WHEN flat THEN last ELSE point END, 6)) AS forecast, greatest(0, round(CASE WHEN flat THEN last ELSE point - 1.96 * sqrt(rest / greatest(n - 2, 1)) END, 6)) AS low,
  round(CASE WHEN flat THEN last ELSE point + 1.96 * sqrt(rest / greatest(n - 2, 1)) END, 6) AS high, mk_s, mk_tau, mk_z, sen_slope FROM fc0)"""


@query("win08_forecast", W + FREQ + FORECAST + "SELECT * FROM fc")
def win08(spark, sf_dir):
    return tr.forecast(grid(spark, sf_dir), YEAR_END - 1)


MODEL = f""", joined AS (SELECT t.keyword, t.doc_count, t.growth_rate, t.burst_score, t.momentum, l.lifecycle_stage, f.slope, f.r2, f.forecast, f.low, f.high, f.sen_slope
  FROM trends t JOIN fc f ON f.keyword = t.keyword LEFT JOIN life l ON l.keyword = t.keyword WHERE t.doc_count >= 30),
model AS (SELECT *, round(0.5 * CASE WHEN max(momentum) OVER () > min(momentum) OVER () THEN (momentum - min(momentum) OVER ()) / (max(momentum) OVER () - min(momentum) OVER ()) ELSE 0 END
  + 0.3 * CASE WHEN max(burst_score) OVER () > min(burst_score) OVER () THEN (burst_score - min(burst_score) OVER ()) / (max(burst_score) OVER () - min(burst_score) OVER ()) ELSE 0 END
  + 0.2 * CASE WHEN max(sen_slope) OVER () > min(sen_slope) OVER () THEN (sen_slope - min(sen_slope) OVER ()) / (max(sen_slope) OVER () - min(sen_slope) OVER ()) ELSE 0 END, 6) AS hotness FROM joined)"""
ALL = W + FREQ + TRENDS + LIFE + FORECAST + MODEL


def trend_model(spark, sf_dir):
    g = grid(spark, sf_dir)
    t = tr.trend_rows(g, YEAR_START, YEAR_END)
    life = tr.lifecycle(g, t, YEAR_START, YEAR_END).select("keyword", "lifecycle_stage")
    f = tr.forecast(g, YEAR_END - 1).select("keyword", "slope", "r2", "forecast", "low", "high", "sen_slope")
    rows = t.select("keyword", "doc_count", "growth_rate", "burst_score", "momentum").where("doc_count >= 30").join(f, "keyword").join(life, "keyword", "left")
    return tr.hotness(rows)


@query("win09_trend_model", ALL + "SELECT * FROM model")
def win09(spark, sf_dir):
    return trend_model(spark, sf_dir)


@query(
    "win11_summary_lists",
    ALL + """SELECT 'hot' AS list, keyword, hotness AS score FROM (SELECT * FROM model ORDER BY hotness DESC, keyword LIMIT 10) UNION ALL
    SELECT 'emerging', keyword, slope FROM (SELECT * FROM model WHERE slope > 0 ORDER BY slope DESC, keyword LIMIT 5) UNION ALL
    SELECT 'declining', keyword, slope FROM (SELECT * FROM model WHERE slope < 0 ORDER BY slope, keyword LIMIT 5)""",
)
def win11(spark, sf_dir):
    model = trend_model(spark, sf_dir)
    hot = model.orderBy(F.desc("hotness"), "keyword").limit(10).select(F.lit("hot").alias("list"), "keyword", F.col("hotness").alias("score"))
    up = model.where("slope > 0").orderBy(F.desc("slope"), "keyword").limit(5).select(F.lit("emerging").alias("list"), "keyword", F.col("slope").alias("score"))
    down = model.where("slope < 0").orderBy("slope", "keyword").limit(5).select(F.lit("declining").alias("list"), "keyword", F.col("slope").alias("score"))
    return hot.union(up).union(down)


MOMENTUM = f""", b AS (SELECT keyword, sum(count) AS base FROM freq WHERE year BETWEEN {YEAR_START} AND {YEAR_START + 1} GROUP BY keyword), r AS (SELECT keyword, sum(count) AS recent FROM freq WHERE year BETWEEN {YEAR_END - 1} AND {YEAR_END} GROUP BY keyword),
m AS (SELECT coalesce(b.keyword, r.keyword) AS keyword, CAST(coalesce(base, 0) AS BIGINT) AS base, CAST(coalesce(recent, 0) AS BIGINT) AS recent FROM b FULL JOIN r ON b.keyword = r.keyword)"""


@query("win12_report_momentum", W + FREQ + MOMENTUM + "SELECT keyword, base, recent, round((ln(1 + recent) - ln(1 + base)) * ln(1 + recent + base), 6) AS momentum FROM m WHERE recent >= 100")
def win12(spark, sf_dir):
    f = tr.yearly_frequency(roles.doc_keywords(spark, sf_dir))
    total = lambda a, b, name: f.where(F.col("year").between(a, b)).groupBy("keyword").agg(F.sum("count").alias(name))
    both = total(YEAR_START, YEAR_START + 1, "base").join(total(YEAR_END - 1, YEAR_END, "recent"), "keyword", "full_outer").fillna(0)
    return both.where("recent >= 100").select("keyword", "base", "recent", F.round((F.log1p("recent") - F.log1p("base")) * F.log1p(F.col("recent") + F.col("base")), 6).alias("momentum"))


@query("win15_keyword_series", W + FREQ + "SELECT year, count, normalized_df FROM grid WHERE keyword = 'Brand#2'")
def win15(spark, sf_dir):
    return grid(spark, sf_dir).where("keyword = 'Brand#2'").select("year", "count", "normalized_df")


@query(
    "eva03_forecast_backtest",
    W + FREQ + f""", s AS (SELECT keyword, list(normalized_df ORDER BY year) AS v FROM grid WHERE year <= {YEAR_END - 2} GROUP BY keyword),
    p AS (SELECT keyword, round(median((v[j] - v[i]) / (j - i)), 8) AS sen FROM s, range(1, len(v) + 1) a(i), range(1, len(v) + 1) b(j) WHERE i < j GROUP BY keyword),
    o AS (SELECT keyword, regr_slope(normalized_df, year) AS slope, arg_max(normalized_df, year) AS last, max(normalized_df) - min(normalized_df) <= 1e-8 + 1e-5 * abs(arg_min(normalized_df, year)) AS flat FROM grid WHERE year <= {YEAR_END - 2} GROUP BY keyword),
    e AS (SELECT greatest(0, round(CASE WHEN flat THEN last ELSE last + 0.5 * CASE WHEN sen <> 0 THEN sen ELSE slope END END, 6)) AS f, last, g.normalized_df AS y FROM o JOIN p ON o.keyword = p.keyword JOIN grid g ON g.keyword = o.keyword AND g.year = {YEAR_END - 1})
    SELECT count(*) AS keywords, round(avg(abs(f - y)), 6) AS mae, round(sqrt(avg((f - y) * (f - y))), 6) AS rmse, round(avg(abs(last - y)), 6) AS naive_mae, round(corr(f, y), 4) AS pearson, round(avg(CASE WHEN sign(f - last) = sign(y - last) THEN 1.0 ELSE 0.0 END), 4) AS direction FROM e""",
)
def eva03(spark, sf_dir):
    g = grid(spark, sf_dir)
    f = tr.forecast(g, YEAR_END - 2).select("keyword", "forecast")
    pick = lambda y, name: g.where(F.col("year") == y).select("keyword", F.col("normalized_df").alias(name))
    e = f.join(pick(YEAR_END - 2, "last"), "keyword").join(pick(YEAR_END - 1, "y"), "keyword")
    gap = F.col("forecast") - F.col("y")
    same = F.signum(F.col("forecast") - F.col("last")) == F.signum(F.col("y") - F.col("last"))
    return e.agg(
        F.count("*").alias("keywords"), F.round(F.avg(F.abs(gap)), 6).alias("mae"), F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"), F.round(F.avg(F.abs(F.col("last") - F.col("y"))), 6).alias("naive_mae"),
        F.round(F.corr("forecast", "y"), 4).alias("pearson"), F.round(F.avg(same.cast("double")), 4).alias("direction"),
    )


# ---- aggregates and dashboards


@query("agg06_publication_trend", W + "SELECT year, count(*) AS n FROM docs WHERE year IS NOT NULL GROUP BY year")
def agg06(spark, sf_dir):
    docs = roles.baskets(spark, sf_dir).select("doc_id", "year").distinct()
    return docs.where("year is not null").groupBy("year").agg(F.count("*").alias("n"))


@query("agg07_field_distribution", W + "SELECT coalesce(nullif(field, ''), 'unknown') AS field, count(*) AS n FROM docs GROUP BY 1")
def agg07(spark, sf_dir):
    docs = roles.baskets(spark, sf_dir).select("doc_id", "field").distinct()
    return docs.groupBy(F.coalesce(F.nullif("field", F.lit("")), F.lit("unknown")).alias("field")).agg(F.count("*").alias("n"))


@query("agg08_keyword_counts", W + "SELECT keyword, count(*) AS n FROM baskets GROUP BY keyword ORDER BY n DESC, keyword LIMIT 10")
def agg08(spark, sf_dir):
    return roles.baskets(spark, sf_dir).groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(10)


@query(
    "agg09_dashboard",
    W + "SELECT 'total' AS part, '' AS name, count(*) AS n FROM docs UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM docs GROUP BY 2 UNION ALL SELECT 'field', field, count(*) FROM docs GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'keyword', keyword, count(*) AS n FROM baskets GROUP BY 2 ORDER BY n DESC, keyword LIMIT 10)",
)
def agg09(spark, sf_dir):
    lines = roles.baskets(spark, sf_dir)
    docs = lines.select("doc_id", "year", "field").distinct()
    part = lambda kind, name: docs.groupBy(name).agg(F.count("*").alias("n")).select(F.lit(kind).alias("part"), F.col(name).cast("string").alias("name"), "n")
    total = docs.agg(F.count("*").alias("n")).select(F.lit("total").alias("part"), F.lit("").alias("name"), "n")
    top = agg08(spark, sf_dir).select(F.lit("keyword").alias("part"), F.col("keyword").alias("name"), "n")
    return total.union(part("year", "year")).union(part("field", "field")).union(top)


@query(
    "agg10_field_year_matrix",
    W + f"SELECT field, {', '.join(f'count(*) FILTER (year = {y}) AS y{y}' for y in _Y)} FROM docs GROUP BY field",
)
def agg10(spark, sf_dir):
    docs = roles.baskets(spark, sf_dir).select("doc_id", "year", "field").distinct()
    wide = docs.groupBy("field").pivot("year", list(_Y)).count().fillna(0)
    return wide.select("field", *[F.col(str(y)).alias(f"y{y}") for y in _Y])


@query("agg10_source_year_matrix", W + f"SELECT source, {', '.join(f'count(*) FILTER (year = {y}) AS y{y}' for y in _Y)} FROM docs GROUP BY source")
def agg10s(spark, sf_dir):
    docs = roles.baskets(spark, sf_dir).select("doc_id", "year", "source").distinct()
    wide = docs.groupBy("source").pivot("year", list(_Y)).count().fillna(0)
    return wide.select("source", *[F.col(str(y)).alias(f"y{y}") for y in _Y])


@query(
    "agg01_governance_summary",
    W + "SELECT CASE WHEN GROUPING(source) = 0 AND GROUPING(year) = 0 THEN 'source_year' WHEN GROUPING(source) = 0 THEN 'source' WHEN GROUPING(year) = 0 THEN 'year' ELSE 'total' END AS level, source, year, count(*) AS n FROM docs GROUP BY GROUPING SETS ((source, year), (source), (year), ())",
)
def agg01(spark, sf_dir):
    docs = roles.baskets(spark, sf_dir).select("doc_id", "source", "year").distinct()
    level = F.when((F.grouping("source") == 0) & (F.grouping("year") == 0), "source_year").when(F.grouping("source") == 0, "source").when(F.grouping("year") == 0, "year").otherwise("total")
    return docs.cube("source", "year").agg(F.count("*").alias("n"), level.alias("level")).select("level", "source", "year", "n")


@query(
    "agg05_readiness",
    W + f"SELECT CAST(y AS INTEGER) AS year, count(d.doc_id) AS n, greatest(3000 - count(d.doc_id), 0) AS deficit FROM range({YEAR_START}, {YEAR_END + 3}) r(y) LEFT JOIN docs d ON d.year = y GROUP BY y",
)
def agg05(spark, sf_dir):
    docs = roles.baskets(spark, sf_dir).select("doc_id", "year").distinct().groupBy("year").agg(F.count("*").alias("n"))
    years = spark.range(YEAR_START, YEAR_END + 3).select(F.col("id").cast("int").alias("year"))
    return years.join(docs, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(3000 - F.coalesce("n", F.lit(0)), F.lit(0)).alias("deficit"))


@query("agg19_author_year", W + "SELECT author, year, count(*) AS papers FROM doc_authors GROUP BY author, year")
def agg19(spark, sf_dir):
    return roles.doc_authors(spark, sf_dir).groupBy("author", "year").agg(F.count("*").alias("papers"))


@query(
    "agg18_author_profile",
    W + AUTHOR_PAIRS + """, f AS (SELECT author, field, row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, field) AS r, count(*) AS c FROM doc_authors GROUP BY author, field),
    t AS (SELECT author, string_agg(field, '; ' ORDER BY r) AS top_fields, max(field) FILTER (r = 1) AS dominant_field FROM f WHERE r <= 3 GROUP BY author),
    c AS (SELECT author, count(DISTINCT other) AS collaborators FROM (SELECT a AS author, b AS other FROM apairs UNION ALL SELECT b, a FROM apairs) GROUP BY author)
    SELECT d.author, count(*) AS papers, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS active_years, max(coalesce(collaborators, 0)) AS collaborators, max(dominant_field) AS dominant_field, max(top_fields) AS top_fields
    FROM doc_authors d LEFT JOIN c ON c.author = d.author JOIN t ON t.author = d.author GROUP BY d.author""",
)
def agg18(spark, sf_dir):
    docs = roles.doc_authors(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("author").orderBy(F.desc("c"), "field"))
    fields = docs.groupBy("author", "field").agg(F.count("*").alias("c")).withColumn("r", rank).where("r <= 3")
    fields = fields.groupBy("author").agg(F.array_sort(F.collect_list(F.struct("r", "field"))).alias("f")).select(
        "author", F.get("f.field", F.lit(0)).alias("dominant_field"), F.array_join("f.field", "; ").alias("top_fields")
    )
    edges = author_pairs(spark, sf_dir).select("a", "b").distinct()
    peers = co.symmetric(edges).groupBy("node").agg(F.count("*").alias("collaborators")).withColumnRenamed("node", "author")
    base = docs.groupBy("author").agg(F.count("*").alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("year").alias("active_years"))
    return base.join(peers, "author", "left").join(fields, "author").withColumn("collaborators", F.coalesce("collaborators", F.lit(0)))


@query(
    "agg20_network_diagnostics",
    W + AUTHOR_PAIRS + """, e AS (SELECT a, b, count(*) AS w FROM apairs GROUP BY a, b), d AS (SELECT node, count(*) AS k FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node)
    SELECT 'authors' AS metric, CAST(count(DISTINCT author) AS DOUBLE) AS value FROM doc_authors UNION ALL SELECT 'papers', count(DISTINCT doc_id) FROM doc_authors UNION ALL SELECT 'mentions', count(*) FROM doc_authors
    UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'connected_authors', count(*) FROM d UNION ALL SELECT 'max_degree', max(k) FROM d UNION ALL SELECT 'mean_degree', round(avg(k), 6) FROM d UNION ALL SELECT 'repeat_edges', count(*) FILTER (w > 1) FROM e""",
)
def agg20(spark, sf_dir):
    docs = roles.doc_authors(spark, sf_dir)
    edges = agg14(spark, sf_dir)
    degrees = co.symmetric(edges).groupBy("node").agg(F.count("*").alias("k"))
    one = docs.agg(F.count_distinct("author").alias("authors"), F.count_distinct("doc_id").alias("papers"), F.count("*").alias("mentions"))
    two = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("weight") > 1).alias("repeat_edges"))
    three = degrees.agg(F.count("*").alias("connected_authors"), F.max("k").alias("max_degree"), F.round(F.avg("k"), 6).alias("mean_degree"))
    long = lambda t: t.select([F.col(c).cast("double") for c in t.columns]).unpivot([], t.columns, "metric", "value")
    return long(one).union(long(two)).union(long(three))


@query("agg26_network_scale", W + AUTHOR_PAIRS + "SELECT (SELECT count(DISTINCT author) FROM doc_authors) AS all_authors, count(DISTINCT a) + 0 AS left_authors, count(*) AS pair_rows, count(DISTINCT doc_id) AS papers_with_pairs FROM apairs")
def agg26(spark, sf_dir):
    pairs = author_pairs(spark, sf_dir)
    counts = pairs.agg(F.count_distinct("a").alias("left_authors"), F.count("*").alias("pair_rows"), F.count_distinct("doc_id").alias("papers_with_pairs"))
    return roles.doc_authors(spark, sf_dir).agg(F.count_distinct("author").alias("all_authors")).crossJoin(F.broadcast(counts))


@query("agg27_top_keywords", W + "SELECT keyword, count(*) AS n FROM doc_keywords GROUP BY keyword ORDER BY n DESC, keyword LIMIT 15")
def agg27(spark, sf_dir):
    return roles.doc_keywords(spark, sf_dir).groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(15)


@query(
    "agg28_keyword_year_heat",
    W + FREQ + f""", top AS (SELECT keyword FROM freq WHERE year BETWEEN {YEAR_START} AND {YEAR_END} GROUP BY keyword ORDER BY sum(count) DESC, keyword LIMIT 12),
    w AS (SELECT keyword, {', '.join(f'sum(count) FILTER (year = {y}) AS c{y}' for y in _Y)}, max(count) AS m FROM grid WHERE keyword IN (SELECT keyword FROM top) GROUP BY keyword) SELECT keyword, {', '.join(f'round(c{y} / m, 6) AS y{y}' for y in _Y)} FROM w""",
)
def agg28(spark, sf_dir):
    g = grid(spark, sf_dir)
    top = g.groupBy("keyword").agg(F.sum("count").alias("t")).orderBy(F.desc("t"), "keyword").limit(12)
    wide = g.join(top.select("keyword"), "keyword", "left_semi").groupBy("keyword").pivot("year", list(_Y)).agg(F.sum("count"))
    most = F.greatest(*[F.col(str(y)) for y in _Y])
    return wide.select("keyword", *[F.round(F.col(str(y)) / most, 6).alias(f"y{y}") for y in _Y])


# ---- joins, sets, top-k

@query("joi03_trend_degree_union", W + FREQ + TRENDS + PAIRS + EDGES + """, g AS (SELECT node, round(sum(weight), 6) AS weighted_degree, count(*) AS neighbor_count FROM (SELECT a AS node, weight FROM edges UNION ALL SELECT b, weight FROM edges) GROUP BY node)
    SELECT coalesce(t.keyword, g.node) AS keyword, doc_count, momentum, coalesce(weighted_degree, 0) AS weighted_degree, coalesce(neighbor_count, 0) AS neighbor_count FROM trends t FULL JOIN g ON g.node = t.keyword""")
def joi03(spark, sf_dir):
    degree = co.symmetric(keyword_edges(spark, sf_dir), "weight").groupBy(F.col("node").alias("keyword")).agg(F.round(F.sum("weight"), 6).alias("weighted_degree"), F.count("*").alias("neighbor_count"))
    both = trends(spark, sf_dir).select("keyword", "doc_count", "momentum").join(degree, "keyword", "full_outer")
    return both.fillna(0, ["weighted_degree", "neighbor_count"])


@query("joi05_inner_edges", W + PAIRS + EDGES + ", top AS (SELECT keyword FROM doc_keywords GROUP BY keyword ORDER BY count(*) DESC, keyword LIMIT 10) SELECT * FROM edges WHERE a IN (SELECT keyword FROM top) AND b IN (SELECT keyword FROM top)")
def joi05(spark, sf_dir):
    top = roles.doc_keywords(spark, sf_dir).groupBy("keyword").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "keyword").limit(10)
    return co.within(keyword_edges(spark, sf_dir), top, "keyword")


@query("joi02_lifecycle_join", W + FREQ + TRENDS + LIFE + "SELECT t.keyword, t.momentum, l.lifecycle_stage FROM trends t LEFT JOIN life l ON l.keyword = t.keyword")
def joi02(spark, sf_dir):
    g = grid(spark, sf_dir)
    t = tr.trend_rows(g, YEAR_START, YEAR_END)
    return t.select("keyword", "momentum").join(tr.lifecycle(g, t, YEAR_START, YEAR_END).select("keyword", "lifecycle_stage"), "keyword", "left")


@query("joi09_ordered_authors", W + "SELECT doc_id, array_to_string((list(CAST(author AS VARCHAR) ORDER BY position, author))[1:12], '; ') AS authors, max(year) AS year FROM doc_authors GROUP BY doc_id")
def joi09(spark, sf_dir):
    docs = roles.doc_authors(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "author"))).alias("p"), F.max("year").alias("year"))
    return docs.select("doc_id", F.array_join(F.slice(F.col("p.author"), 1, 12).cast("array<string>"), "; ").alias("authors"), "year")


@query("joi10_ego_graph", W + PAIRS + EDGES + "SELECT * FROM edges WHERE a = 'Brand#2' OR b = 'Brand#2' ORDER BY weight DESC, a, b LIMIT 20")
def joi10(spark, sf_dir):
    return co.ego(keyword_edges(spark, sf_dir), "Brand#2", 20)


@query("top06_top_authors_by_field", W + ", c AS (SELECT field, author, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, author) AS r FROM doc_authors GROUP BY field, author) SELECT field, author, n, CAST(r AS INTEGER) AS r FROM c WHERE r <= 5")
def top06(spark, sf_dir):
    counts = roles.doc_authors(spark, sf_dir).groupBy("field", "author").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "author"))).where("r <= 5")


@query("top07_keyword_lookup", W + "SELECT keyword, count(*) AS n FROM doc_names WHERE contains(replace(lower(keyword), '-', ' '), 'ring') GROUP BY keyword ORDER BY (keyword = 'ring') DESC, n DESC, keyword LIMIT 5")
def top07(spark, sf_dir):
    counts = roles.doc_names(spark, sf_dir).where(F.replace(F.lower("keyword"), F.lit("-"), F.lit(" ")).contains("ring")).groupBy("keyword").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc(F.col("keyword") == "ring"), F.desc("n"), "keyword").limit(5)


@query("top08_suggestions", W + ", c AS (SELECT keyword, count(*) AS n FROM doc_names GROUP BY keyword) SELECT keyword, n, CAST((contains(keyword, 'small'))::INT + (contains(keyword, 'ring'))::INT AS INTEGER) AS shared FROM c WHERE contains(keyword, 'small') OR contains(keyword, 'ring') ORDER BY shared DESC, n DESC, keyword LIMIT 5")
def top08(spark, sf_dir):
    counts = roles.doc_names(spark, sf_dir).groupBy("keyword").agg(F.count("*").alias("n"))
    tokens = F.array(F.lit("small"), F.lit("ring"))
    shared = F.size(F.filter(tokens, lambda t: F.contains(F.col("keyword"), t)))
    return counts.withColumn("shared", shared).where("shared > 0").orderBy(F.desc("shared"), F.desc("n"), "keyword").limit(5)


@query("top04_graph_seeds", W + ", s AS (SELECT DISTINCT doc_id FROM doc_keywords WHERE keyword IN ('Brand#2', 'Brand#3')), c AS (SELECT doc_id FROM s ORDER BY doc_id LIMIT 4000) SELECT keyword, count(*) AS n FROM doc_keywords WHERE doc_id IN (SELECT doc_id FROM c) AND keyword NOT IN ('Brand#2', 'Brand#3') GROUP BY keyword ORDER BY n DESC, keyword LIMIT 8")
def top04(spark, sf_dir):
    docs = roles.doc_keywords(spark, sf_dir)
    seeds = docs.where(F.col("keyword").isin("Brand#2", "Brand#3")).select("doc_id").distinct().orderBy("doc_id").limit(4000)
    near = docs.join(seeds, "doc_id", "left_semi").where(~F.col("keyword").isin("Brand#2", "Brand#3"))
    return near.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(8)


@query("set01_shared_keywords", W + """, k AS (SELECT doc_id, list(keyword) AS ks FROM doc_keywords GROUP BY doc_id)
    SELECT x.doc_id, x.doc_id + 1 AS other, array_to_string(list_sort(list_intersect(x.ks, y.ks))[1:10], '; ') AS shared FROM k x JOIN k y ON y.doc_id = x.doc_id + 1 WHERE len(list_intersect(x.ks, y.ks)) > 0""")
def set01(spark, sf_dir):
    sets = roles.doc_keywords(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("keyword").alias("ks"))
    other = sets.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ks").alias("other_ks"))
    both = sets.join(other, "doc_id").withColumn("s", F.array_sort(F.array_intersect("ks", "other_ks"))).where(F.size("s") > 0)
    return both.select("doc_id", (F.col("doc_id") + 1).alias("other"), F.array_join(F.slice("s", 1, 10), "; ").alias("shared"))


@query("set03_removed_ids", W + "SELECT DISTINCT doc_id FROM docs WHERE year < 1998 EXCEPT SELECT doc_id FROM docs WHERE field = 'BUILDING'")
def set03(spark, sf_dir):
    docs = roles.baskets(spark, sf_dir).select("doc_id", "year", "field").distinct()
    return docs.where("year < 1998").select("doc_id").join(docs.where("field = 'BUILDING'").select("doc_id"), "doc_id", "left_anti")


@query("flt01_year_window", W + f"SELECT doc_id, year FROM docs WHERE year BETWEEN {YEAR_START} AND {YEAR_END}")
def flt01(spark, sf_dir):
    return roles.baskets(spark, sf_dir).select("doc_id", "year").distinct().where(F.col("year").between(YEAR_START, YEAR_END))


@query("flt02_future_gate", W + "SELECT CASE WHEN year > 2000 THEN 'future_year_suspect' ELSE CAST(year AS VARCHAR) END AS partition_year, year AS original_year, count(*) AS n FROM docs GROUP BY ALL")
def flt02(spark, sf_dir):
    docs = roles.baskets(spark, sf_dir).select("doc_id", "year").distinct()
    part = F.when(F.col("year") > 2000, "future_year_suspect").otherwise(F.col("year").cast("string"))
    return docs.groupBy(part.alias("partition_year"), F.col("year").alias("original_year")).agg(F.count("*").alias("n"))


@query("sca22_direction", W + FREQ + TRENDS + "SELECT keyword, CASE WHEN growth_rate > 0.05 THEN 'rising' WHEN growth_rate < -0.05 THEN 'falling' ELSE 'stable' END AS direction FROM trends")
def sca22(spark, sf_dir):
    g = F.col("growth_rate")
    return trends(spark, sf_dir).select("keyword", F.when(g > 0.05, "rising").when(g < -0.05, "falling").otherwise("stable").alias("direction"))


@query("ret09_graph_expansion", W + PAIRS + """, q AS (SELECT CASE a WHEN 'Brand#2' THEN b ELSE a END AS keyword, count(*) AS n FROM pairs WHERE a = 'Brand#2' OR b = 'Brand#2' GROUP BY 1)
    SELECT keyword, n FROM q ORDER BY n DESC, keyword LIMIT 8""")
def ret09(spark, sf_dir):
    pairs = co.symmetric(keyword_pairs(spark, sf_dir)).where("node = 'Brand#2'")
    return pairs.groupBy(F.col("other").alias("keyword")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(8)


@query("src10_quota_sample", W + """, r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM docs) SELECT doc_id, source FROM r WHERE r <= ceil(1000 / 5.0)""")
def src10(spark, sf_dir):
    docs = roles.baskets(spark, sf_dir).select("doc_id", "source").distinct()
    return records.quota_sample(docs, "source", "doc_id", 1000, 5).select("doc_id", "source")


@query("agg24_year_shares", W + "SELECT year, field, round(count(*) / sum(count(*)) OVER (PARTITION BY year), 6) AS share FROM docs GROUP BY year, field")
def agg24(spark, sf_dir):
    docs = roles.baskets(spark, sf_dir).select("doc_id", "year", "field").distinct().groupBy("year", "field").agg(F.count("*").alias("n"))
    return docs.select("year", "field", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("year")), 6).alias("share"))
