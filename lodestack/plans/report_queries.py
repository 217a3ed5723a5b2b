"""Reports over other queries: evaluation pack, overview, detail look-ups, claim checks, diagnostics, clean payloads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import filters as fl
from ..operators import search as se
from ..tables import table
from . import basket_queries as bq
from . import extra_queries as eq
from . import text_queries as tq

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Evaluations of the pack: the query, the column that names its rows (if there are several), and its measures.
PACK = {
    "eva01_self_retrieval": (tq, "kind", ("queries", "recall_1", "recall_5", "recall_10", "mrr_10")),
    "eva02_topic_relevance": (eq, None, ("queries", "relevance")),
    "eva03_forecast_backtest": (bq, None, ("keywords", "mae", "rmse", "naive_mae", "pearson", "direction")),
    "eva04_hit_rates": (tq, None, ("same_field", "mean_cosine", "pairs")),
}


def _pack_sql() -> str:
    part = "SELECT '{q}' AS evaluation, {g} AS part, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM ({s})"
    rows = [part.format(q=q, g=g or "'all'", m=m, s=module.ORACLES[q]) for q, (module, g, measures) in PACK.items() for m in measures]
    return " UNION ALL ".join(rows)


@query("eva05_evaluation_pack", _pack_sql())
def eva05(spark, sf_dir):
    out = None
    for name, (module, group, measures) in PACK.items():
        found = module.QUERIES[name](spark, sf_dir)
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        long = found.select(F.lit(name).alias("evaluation"), (F.col(group) if group else F.lit("all")).alias("part"), F.inline(pairs))
        out = long if out is None else out.unionByName(long)
    return out


@query(
    "ret12_claim_checks",
    tq.STANCE + ", " + tq.KNN + """, e AS (SELECT query AS claim, doc, cosine FROM near WHERE rank <= 6), j AS (SELECT e.*, s.stance FROM e LEFT JOIN s ON s.doc_id = e.doc), g AS (SELECT claim, count(stance) AS judged, count(*) FILTER (stance = 'SUPPORT') AS support, count(*) FILTER (stance = 'CONTRADICT') AS contradict, max(cosine) AS top, max(cosine) FILTER (stance = 'SUPPORT') AS best FROM j GROUP BY claim)
    SELECT claim, CASE WHEN judged > 0 THEN 'stance' ELSE 'similarity' END AS method, support, contradict, round(top, 3) AS top_cosine, CASE WHEN judged = 0 THEN CASE WHEN top >= 0.84 THEN 'strong' WHEN top >= 0.78 THEN 'partial' ELSE 'insufficient' END WHEN support > 0 AND contradict > 0 THEN 'disputed' WHEN contradict > 0 THEN 'refuted' WHEN support > 0 THEN CASE WHEN best >= 0.84 THEN 'strong' ELSE 'partial' END ELSE 'insufficient' END AS verdict FROM g""",
)
def ret12_checks(spark, sf_dir):
    evidence = tq.nearest(spark, sf_dir, 6).select(F.col("query").alias("claim"), "doc", "cosine")
    stances = tq.stances(spark, sf_dir).select(F.col("doc_id").alias("doc"), "stance")
    return se.claim_checks(evidence.join(stances, "doc", "left"))


@query("ret18_overview", bq.ALL + """SELECT 'hot' AS list, keyword, CAST(rank AS INTEGER) AS rank, CASE WHEN isnan(hotness) THEN NULL ELSE hotness END AS score FROM (SELECT *, row_number() OVER (ORDER BY hotness DESC, keyword) AS rank FROM model) WHERE rank <= 30
UNION ALL SELECT 'emerging', keyword, CAST(rank AS INTEGER), CASE WHEN isnan(slope) THEN NULL ELSE slope END FROM (SELECT *, row_number() OVER (ORDER BY slope DESC, keyword) AS rank FROM model WHERE slope > 0) WHERE rank <= 20""")
def ret18(spark, sf_dir):
    model = bq.trend_model(spark, sf_dir)
    hot, up = model.orderBy(F.desc("hotness"), "keyword").limit(30), model.where("slope > 0").orderBy(F.desc("slope"), "keyword").limit(20)

    def ranked(rows, name, score):  # at most 30 rows
        order = Window.partitionBy(F.lit(name)).orderBy(F.desc(score), "keyword")
        return rows.select(F.lit(name).alias("list"), "keyword", F.row_number().over(order).alias("rank"), sc.without_nan(F.col(score)).alias("score"))

    return ranked(hot, "hot", "hotness").union(ranked(up, "emerging", "slope"))


@query("ret17_survey_material", tq.LEX + "SELECT query, rank, doc, d.source, split_part(d.text, chr(10), 1) AS title, d.text[1:160] AS snippet FROM lex JOIN documents d ON d.doc_id = lex.doc WHERE rank <= 10")
def ret17_survey(spark, sf_dir):
    found = tq.docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "source", tq.first_line().alias("title"), F.substring("text", 1, 160).alias("snippet"))
    return tq.lexical(spark, sf_dir).where("rank <= 10").select("query", "rank", "doc").join(found, "doc")


@query("ret17_compared", f"WITH {tq.KNN} SELECT query AS a, doc AS b, cosine, x.source AS source_a, y.source AS source_b, abs(length(x.text) - length(y.text)) AS length_gap, x.lang = y.lang AS same_lang FROM near JOIN documents x ON x.doc_id = query JOIN documents y ON y.doc_id = doc WHERE rank = 1")
def ret17_compared(spark, sf_dir):
    one = lambda n: tq.docs(spark, sf_dir).select(F.col("doc_id").alias(n), F.col("source").alias(f"source_{n}"), F.length("text").alias(f"n_{n}"), F.col("lang").alias(f"lang_{n}"))
    both = tq.nearest(spark, sf_dir, 1).select(F.col("query").alias("a"), F.col("doc").alias("b"), "cosine").join(one("a"), "a").join(one("b"), "b")
    return both.select("a", "b", "cosine", "source_a", "source_b", F.abs(F.col("n_a") - F.col("n_b")).alias("length_gap"), (F.col("lang_a") == F.col("lang_b")).alias("same_lang"))


@query("sca02_record_hash", """SELECT doc_id, sha1('{"doc_id":' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS hash FROM documents""")
def sca02(spark, sf_dir):
    d = tq.docs(spark, sf_dir).select("source", "lang", "doc_id")
    return d.select("doc_id", sc.record_hash(d.columns).alias("hash"))


@query("sca23_payload", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS l_quantity, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio FROM lineitem")
def sca23(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax") / F.col("l_discount")).alias("ratio"), "l_suppkey")
    return sc.payload(items, keep=("l_orderkey", "l_linenumber", "l_quantity", "ratio"), whole=("l_quantity",))


@query("flt10_nested_field", "SELECT p_partkey, contains(lower(p_type || ' ' || array_to_string(string_split(p_name, ' '), ' ') || ' ' || p_brand), 'brass') AS found FROM part")
def flt10(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.array(F.struct(F.col("p_type").alias("display_name"))).alias("subject"), F.split("p_name", " ").alias("keywords"), F.struct(F.col("p_brand").alias("term")).alias("categories"))).alias("raw"))
    return part.select("p_partkey", fl.names_field(F.col("raw"), "Brass").alias("found"))


@query("mod08_diagnostics", "SELECT 'documents' AS method, CASE WHEN count(*) > 0 THEN 'ready' ELSE 'empty' END AS status, count(*) AS records, 'text' AS note FROM documents UNION ALL SELECT 'embeddings', CASE WHEN count(*) > 0 THEN 'ready' ELSE 'empty' END, count(*), 'vectors' FROM embeddings UNION ALL SELECT 'labels', CASE WHEN count(*) > 0 THEN 'ready' ELSE 'empty' END, count(*), 'stances' FROM labels")
def mod08(spark, sf_dir):
    rows = None
    for name, note in (("documents", "text"), ("embeddings", "vectors"), ("labels", "stances")):
        n = F.count("*")
        one = table(spark, sf_dir, name).agg(F.lit(name).alias("method"), F.when(n > 0, "ready").otherwise("empty").alias("status"), n.alias("records"), F.lit(note).alias("note"))
        rows = one if rows is None else rows.union(one)
    return rows
