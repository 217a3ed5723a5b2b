"""Queries over the keyword graph, chunks, term statistics and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import brandes
from ..operators import chunks as ch
from ..operators import cooccurrence as co
from ..operators import graph as gr
from ..operators import textstats as ts
from ..operators.components import connected_components
from ..storage import dealt, stage
from ..streaming import jobs
from ..tables import table
from . import roles
from .basket_queries import EDGES, PAIRS, W, keyword_edges

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BOTH = ", both_ways AS (SELECT a AS node, b AS other, weight FROM edges UNION ALL SELECT b, a, weight FROM edges)"
NAME_PAIRS = """, nsized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM doc_names), npairs AS (SELECT x.doc_id, x.keyword AS a, y.keyword AS b FROM nsized x JOIN nsized y ON x.doc_id = y.doc_id AND x.keyword < y.keyword), edges AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS weight FROM npairs GROUP BY a, b)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def name_edges(spark, sf_dir):
    pairs = co.document_pairs(roles.doc_names(spark, sf_dir), "doc_id", "keyword")
    return pairs.groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))


def sparse_edges(spark, sf_dir):
    """Supplier pairs that share orders, weighted by how many."""
    sets = stage(co.item_sets(roles.order_suppliers(spark, sf_dir), "doc_id", "author"), "sets")
    pairs = co.set_pairs(sets, "doc_id")
    pairs = dealt(pairs, 2 * roles.size(spark, sf_dir), "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))


SPARSE = """, s AS (SELECT x.author AS a, y.author AS b, CAST(count(*) AS DOUBLE) AS weight FROM doc_authors x JOIN doc_authors y ON x.doc_id = y.doc_id AND x.author < y.author GROUP BY ALL), edges AS (SELECT * FROM s)"""


@query("gra01_weighted_degree", W + PAIRS + EDGES + BOTH + "SELECT node, round(sum(weight), 6) AS weighted_degree, count(*) AS neighbor_count FROM both_ways GROUP BY node")
def gra01(spark, sf_dir):
    return gr.weighted_degree(keyword_edges(spark, sf_dir))


_RANKS = "".join(
    f", r{k} AS (SELECT l.other AS node, 0.15 / any_value(n) + 0.85 * sum(r.rank * l.weight / o.out) AS rank FROM both_ways l JOIN outs o ON o.node = l.node JOIN r{k - 1} r ON r.node = l.node, nn GROUP BY l.other)" for k in range(1, 31)
)


@query("gra02_page_rank", W + PAIRS + EDGES + BOTH + ", outs AS (SELECT node, sum(weight) AS out FROM both_ways GROUP BY node), nn AS (SELECT count(*) AS n FROM outs), r0 AS (SELECT node, 1.0 / n AS rank FROM outs, nn)" + _RANKS + " SELECT node, round(rank, 6) AS rank FROM r30")
def gra02(spark, sf_dir):
    return gr.page_rank(keyword_edges(spark, sf_dir)).select("node", F.round("rank", 6).alias("rank"))


@query("gra03_betweenness")
def gra03(spark, sf_dir):
    """Of all start nodes, counting hops; tests hold it against Brandes' algorithm in plain Python."""
    return brandes.betweenness(sparse_edges(spark, sf_dir), weighted=False).select("node", F.round("betweenness", 6).alias("betweenness"))


@query("gra04_eigenvector")
def gra04(spark, sf_dir):
    return gr.eigenvector_centrality(name_edges(spark, sf_dir)).select("node", F.round("value", 6).alias("value"))


@query("gra05_core_numbers")
def gra05(spark, sf_dir):
    return gr.core_numbers(sparse_edges(spark, sf_dir))


@query(
    "gra06_components",
    "WITH RECURSIVE " + roles.BASKETS_SQL + SPARSE + ", bw AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges), reach(node, seen) AS (SELECT DISTINCT x, x FROM bw UNION SELECT r.node, bw.y FROM reach r JOIN bw ON bw.x = r.seen) SELECT node, min(seen) AS component FROM reach GROUP BY node",
)
def gra06(spark, sf_dir):
    return connected_components(sparse_edges(spark, sf_dir), "a", "b")


@query("gra07_communities")
def gra07(spark, sf_dir):
    return gr.best_communities(stage(name_edges(spark, sf_dir), "edges"))


LABELS = ", labels AS (SELECT node, node[1:1] AS community FROM (SELECT DISTINCT node FROM both_ways))"


def given_labels(edges):
    return co.symmetric(edges).select("node", F.substring("node", 1, 1).alias("community")).distinct()


@query("gra08_modularity", W + NAME_PAIRS + BOTH + LABELS + ", l AS (SELECT x.community AS c1, y.community AS c2, weight FROM both_ways w JOIN labels x ON x.node = w.node JOIN labels y ON y.node = w.other), m AS (SELECT sum(weight) AS m2 FROM l), p AS (SELECT c1, sum(weight) AS total, sum(weight) FILTER (c1 = c2) AS inside FROM l GROUP BY c1) SELECT round(sum(coalesce(inside, 0) / m2 - (total / m2) * (total / m2)), 6) AS modularity FROM p, m")
def gra08(spark, sf_dir):
    edges = name_edges(spark, sf_dir)
    return gr.modularity(edges, given_labels(edges))


@query(
    "gra09_community_table",
    W + NAME_PAIRS + BOTH + LABELS + """, i AS (SELECT e.*, x.community FROM edges e JOIN labels x ON x.node = e.a JOIN labels y ON y.node = e.b AND y.community = x.community), d AS (SELECT node, round(sum(weight), 6) AS d FROM (SELECT a AS node, weight FROM i UNION ALL SELECT b, weight FROM i) GROUP BY node),
    r AS (SELECT l.*, row_number() OVER (PARTITION BY community ORDER BY coalesce(d, 0) DESC, l.node) AS r FROM labels l LEFT JOIN d ON d.node = l.node), t AS (SELECT community, string_agg(node, '; ' ORDER BY r) AS members FROM r WHERE r <= 8 GROUP BY community), s AS (SELECT community, count(*) AS size FROM labels GROUP BY community), w AS (SELECT community, count(*) AS inner_edges, round(sum(weight), 6) AS total_weight FROM i GROUP BY community)
    SELECT s.community, size, coalesce(inner_edges, 0) AS inner_edges, coalesce(total_weight, 0) AS total_weight, members FROM s LEFT JOIN w ON w.community = s.community JOIN t ON t.community = s.community""",
)
def gra09(spark, sf_dir):
    edges = name_edges(spark, sf_dir)
    return gr.community_table(edges, given_labels(edges))


@query("gra10_ego", W + NAME_PAIRS + "SELECT * FROM edges WHERE a = 'small ring' OR b = 'small ring' ORDER BY weight DESC, a, b LIMIT 30")
def gra10(spark, sf_dir):
    return co.ego(name_edges(spark, sf_dir), "small ring", 30)


@query("gra11_topic_bipartite", W + "SELECT DISTINCT p.p_type AS topic, w AS keyword, count(*) AS weight FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS w FROM part) p GROUP BY ALL")
def gra11(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("topic"), F.explode(F.split("p_name", " ")).alias("keyword")).groupBy("topic", "keyword").agg(F.count("*").alias("weight"))


@query("gra12_export_metrics", W + NAME_PAIRS + "SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT a FROM edges UNION SELECT b FROM edges)) AS nodes, sum(weight) AS weight FROM edges")
def gra12(spark, sf_dir):
    edges = name_edges(spark, sf_dir)
    nodes = co.symmetric(edges).agg(F.count_distinct("node").alias("nodes"))
    return edges.agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")).crossJoin(F.broadcast(nodes))


@query("top02_central_nodes", W + NAME_PAIRS + BOTH + ", d AS (SELECT node, sum(weight) AS d FROM both_ways GROUP BY node ORDER BY d DESC, node LIMIT 20) SELECT * FROM edges WHERE a IN (SELECT node FROM d) AND b IN (SELECT node FROM d) AND weight >= 2")
def top02(spark, sf_dir):
    edges = name_edges(spark, sf_dir)
    top = co.symmetric(edges, "weight").groupBy("node").agg(F.sum("weight").alias("d")).orderBy(F.desc("d"), "node").limit(20)
    return co.within(edges, top, "node").where("weight >= 2")


# ---- chunks, terms, vectors

def chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text")
    return ch.chunked(docs, "doc_id", {"title": "title", "full_text": "text"})


@query("win13_sca14_chunks")
def win13(spark, sf_dir):
    return chunks(spark, sf_dir)


@query("agg23_chunk_summary")
def agg23(spark, sf_dir):
    return ch.chunk_summary(chunks(spark, sf_dir), "doc_id")


GRAMS = r"wl AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), g AS (SELECT doc, unnest(w) AS term FROM wl UNION ALL SELECT doc, w[i] || ' ' || w[i + 1] FROM wl, range(1, greatest(len(w), 1)) r(i)), c AS (SELECT doc, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY doc) AS n_terms FROM g GROUP BY doc, term), nd AS (SELECT count(*) AS nd FROM documents)"


def counts(spark, sf_dir):
    return stage(ts.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "terms")


TERM_STOP = ", ".join(f"'{w}'" for w in C.TERM_STOP)
GRAMS3 = r"wl AS (SELECT doc_id AS doc, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: x NOT IN (" + TERM_STOP + ")) AS w FROM documents), g AS (SELECT doc, unnest(w) AS term FROM wl UNION ALL SELECT doc, w[i] || ' ' || w[i + 1] FROM wl, range(1, greatest(len(w), 1)) r(i) UNION ALL SELECT doc, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM wl, range(1, greatest(len(w) - 1, 1)) r(i)), c AS (SELECT doc, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY doc) AS n_terms FROM g GROUP BY doc, term), nd AS (SELECT count(*) AS nd FROM documents)"


@query("mod01_mean_tf_idf", f"WITH {GRAMS}, st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY term), v AS (SELECT term, df, ln((1.0 + nd) / (1 + df)) + 1 AS idf FROM st, nd WHERE df >= 5 AND df <= 0.85 * nd ORDER BY cf DESC, term LIMIT 3000), x AS (SELECT doc, c.term, df, (1 + ln(tf)) * idf AS w FROM c JOIN v ON v.term = c.term), m AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc) SELECT term, df, round(sum(w / norm) / any_value(nd), 6) AS score FROM x JOIN m ON m.doc = x.doc, nd GROUP BY term, df ORDER BY score DESC, term LIMIT 120")
def mod01(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ts.mean_tf_idf_of(docs, "doc_id", "text", docs.count())


@query("mod02_simple_tf_idf", f"WITH {GRAMS3} SELECT term, count(*) AS df, round(sum(tf / n_terms) * (ln((any_value(nd) + 1.0) / (count(*) + 1)) + 1), 6) AS score FROM c, nd GROUP BY term ORDER BY score DESC, term LIMIT 120")
def mod02(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ts.simple_tf_idf_of(docs, "doc_id", "text", docs.count(), 1, 3, C.TERM_STOP)


@query("mod03_lda_topics")
def mod03(spark, sf_dir):
    return ts.lda_topics(table(spark, sf_dir, "documents"), "doc_id", "text")[0]


@query("win10_topic_years")
def win10(spark, sf_dir):
    best = ts.lda_topics(table(spark, sf_dir, "documents"), "doc_id", "text")[1]
    lang = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang")
    return best.join(lang, "doc").groupBy("topic", "lang").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"))


@query("mod06_hashed_vectors")
def mod06(spark, sf_dir):
    return ts.hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc", F.array_join(F.transform("vector", lambda x: F.round(x, 4)).cast("array<string>"), ",").alias("vector"))


@query("ret04_cell_search")
def ret04(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return ts.cell_search(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding")


# ---- incremental upkeep and streams

@query("str03_incremental_edges", W + PAIRS + "SELECT a, b, count(*) AS n FROM pairs GROUP BY a, b")
def str03(spark, sf_dir):
    docs = roles.doc_keywords(spark, sf_dir).select("doc_id", "keyword")
    old = docs.where("doc_id % 3 != 0")
    return jobs.updated_edges(jobs.edge_counts(old), old, docs)


@query("str01_landing_dedupe", "SELECT count(DISTINCT event_id) AS n FROM events")
def str01(spark, sf_dir):
    return jobs.drained(spark, jobs.landing(spark, f"{sf_dir}/events.parquet", "event_id", "ts"), "landing").agg(F.count("*").alias("n"))


@query("str02_stream_windows", "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY ALL")
def str02(spark, sf_dir):
    stream = jobs.stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "40 days")
    counts_ = stream.groupBy("user_id", F.window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("n"))
    return jobs.drained(spark, counts_, "limits", "complete").select("user_id", F.col("w.start").alias("minute"), "n")


@query("str04_latest_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def str04(spark, sf_dir):
    return jobs.latest(spark, f"{sf_dir}/events.parquet", ["user_id"], "event_id").select("user_id", "event_type", "event_id")
