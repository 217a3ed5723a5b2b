"""Composed queries: hybrid search, evidence, folding, sinks read back, ledgers, report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as sc
from ..operators import dedupe as dd
from ..operators import graph as gr
from ..operators import paths
from ..operators import search as se
from ..operators import textstats as ts
from ..operators import topics as tp
from ..operators.components import connected_components
from ..sources import records
from ..storage import new_path, stage
from ..streaming import jobs
from ..tables import table
from . import basket_queries as bq
from . import graph_queries as gq
from . import roles
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


FUSED = tq.ORACLES["ret05_fusion"].rsplit("SELECT * FROM r", 1)[0]


@query("ret06_hybrid_search", FUSED + ", top AS (SELECT * FROM r WHERE rank <= 10) SELECT query, doc, rank, score, d.source, d.text[1:80] AS snippet, CAST(row_number() OVER (PARTITION BY query ORDER BY (rank > 5)::INT, CASE WHEN rank <= 5 THEN -doc END, rank) AS INTEGER) AS shown FROM top LEFT JOIN documents d ON d.doc_id = top.doc")
def ret06(spark, sf_dir):
    # the first ranks are shown newest first (larger ids), the rest by rank
    top = tq.ret05(spark, sf_dir).select("query", "doc", "rank", "score")
    full = top.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", F.substring("text", 1, 80).alias("snippet")), "doc", "left")
    head = F.col("rank") <= 5
    order = Window.partitionBy("query").orderBy((~head).cast("int"), F.when(head, -F.col("doc")).asc_nulls_last(), "rank")
    return full.withColumn("shown", F.row_number().over(order))


@query(
    "ret08_lexical_evidence",
    "WITH " + tq.TERMS + r""", hit AS (SELECT doc_id AS doc, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term, 20 AS w FROM documents UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\p{L}\p{N}]+'))), 60 FROM documents),
    s AS (SELECT query, doc, CAST(sum(w * 4) AS BIGINT) AS score FROM hit JOIN terms ON terms.term = hit.term GROUP BY query, doc), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 3""",
)
def ret08(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    field = lambda text, weight: docs.select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(sc.word_list(text))).alias("term"), F.lit(weight).alias("w"))
    hits = field(F.col("text"), 20).union(field(tq.first_line(), 60))
    terms = se.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    scored = hits.join(F.broadcast(terms) if terms.limit(100_001).count() <= 100_000 else terms, "term").groupBy("query", "doc").agg(F.sum(F.col("w") * 4).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))).where("rank <= 3")


@query("ret15_fold_variants", "WITH k AS (SELECT p_name AS keyword, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS key, count(*) AS n FROM part GROUP BY ALL) SELECT key, max(keyword) AS keyword, string_agg(keyword, '; ' ORDER BY keyword) AS variants, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY key")
def ret15(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("keyword")).agg(F.count("*").alias("n"))
    return names.groupBy(sc.variant_key(F.col("keyword")).alias("key")).agg(F.max("keyword").alias("keyword"), F.array_join(F.array_sort(F.collect_list("keyword")), "; ").alias("variants"), F.sum("n").alias("n"))


@query("ret16_tiered_answer", bq.ALL + """, hot AS (SELECT keyword FROM model ORDER BY hotness DESC, keyword LIMIT 5), a AS (SELECT 'Brand#2' AS q UNION ALL SELECT 'Brand#7' UNION ALL SELECT 'nothing'), t AS (SELECT q, 1 AS tier FROM a WHERE q IN (SELECT keyword FROM hot) UNION ALL SELECT q, 2 FROM a WHERE q IN (SELECT keyword FROM model) UNION ALL SELECT q, 3 FROM a) SELECT q AS keyword, min(tier) AS tier FROM t GROUP BY q""")
def ret16(spark, sf_dir):
    model = stage(bq.trend_model(spark, sf_dir).select("keyword", "hotness"), "model")
    hot = model.orderBy(F.desc("hotness"), "keyword").limit(5).select("keyword", F.lit(1).alias("tier"))
    asked = spark.createDataFrame([("Brand#2",), ("Brand#7",), ("nothing",)], "keyword string")
    tiers = hot.union(model.select("keyword", F.lit(2).alias("tier"))).join(asked, "keyword", "left_semi").union(asked.select("keyword", F.lit(3).alias("tier")))
    return tiers.groupBy("keyword").agg(F.min("tier").alias("tier"))


@query("set02_bag_union", "SELECT doc_id, source FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, source FROM documents WHERE source = 'src1'")
def set02(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return d.where("lang = 'en'").unionByName(d.where("source = 'src1'")).select("doc_id", "source")


@query("set04_merged_evidence", tq.LEX + ", m AS (SELECT query // 2 AS question, doc, min((query % 2) * 1000 + rank) AS place FROM lex WHERE rank <= 6 GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY place, doc) AS INTEGER) AS position FROM m) SELECT question, doc, position FROM r WHERE position <= 6")
def set04(spark, sf_dir):
    arms = tq.lexical(spark, sf_dir).where("rank <= 6").select(F.expr("query div 2").alias("question"), "doc", ((F.col("query") % 2) * 1000 + F.col("rank")).alias("place"))
    merged = arms.groupBy("question", "doc").agg(F.min("place").alias("place"))
    return merged.withColumn("position", F.row_number().over(Window.partitionBy("question").orderBy("place", "doc"))).where("position <= 6").drop("place")


@query("eva02_topic_relevance", tq.LEX + ", t AS (SELECT lex.query, max(contains(lower(d.text), lower(b.text[1:12]))::INT) AS hit FROM lex JOIN documents d ON d.doc_id = lex.doc JOIN benchmark b ON b.item_id = lex.query WHERE rank <= 5 GROUP BY lex.query) SELECT count(*) AS queries, round(avg(hit), 6) AS relevance FROM t")
def eva02(spark, sf_dir):
    top = tq.lexical(spark, sf_dir).where("rank <= 5").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.lower(F.substring("text", 1, 12)).alias("term"))
    hits = top.join(asked, "query").groupBy("query").agg(F.max(F.contains(F.lower("text"), F.col("term")).cast("int")).alias("hit"))
    return hits.agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 6).alias("relevance"))


@query("sca12_author_keys", "SELECT s_suppkey, 'name:' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS key FROM supplier")
def sca12(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", sc.author_key(F.lit(None).cast("string"), F.lit(""), F.col("s_name")).alias("key"))


@query("sca16_taxonomy", "SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' OR p_name LIKE '%ring%' THEN 'metal' WHEN p_type LIKE 'ECONOMY%' THEN 'economy' ELSE 'other' END AS domain FROM part")
def sca16(spark, sf_dir):
    kind = F.when(F.col("p_type").contains("STEEL") | F.col("p_name").contains("ring"), "metal").when(F.col("p_type").startswith("ECONOMY"), "economy").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("domain"))


@query("sca24_bibliography", "WITH " + roles.BASKETS_SQL + ", a AS (SELECT doc_id, max(year) AS year, list(CAST(author AS VARCHAR) ORDER BY position, author) AS authors FROM doc_authors GROUP BY doc_id) SELECT doc_id, '@article{' || doc_id || ',' || chr(10) || '  title = {' || 'order ' || doc_id || '},' || chr(10) || '  author = {' || array_to_string(authors, ' and ') || '},' || chr(10) || '  year = {' || year || '}' || chr(10) || '}' AS entry FROM a")
def sca24(spark, sf_dir):
    docs = roles.doc_authors(spark, sf_dir).groupBy("doc_id").agg(F.max("year").alias("year"), F.array_sort(F.collect_list(F.struct("position", "author"))).alias("p"))
    key = F.col("doc_id").cast("string")
    return docs.select("doc_id", sc.bib_entry(key, F.concat(F.lit("order "), key), F.col("p.author").cast("array<string>"), F.col("year")).alias("entry"))


GLOSSARY = {"the": "le", "the and": "le et", "and": "et", "with": "avec"}


@query("joi11_dictionary", r"SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(replace(text, 'the and', ' le et '), 'with', ' avec '), 'and', ' et '), 'the', ' le '), '[\x20\x09-\x0D]+', ' ', 'g'))) AS digest FROM documents")
def joi11(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(sc.expanded(F.col("text"), GLOSSARY).cast("binary")).alias("digest"))


@query("ded02_rerun", "SELECT source, count(*) AS n FROM (SELECT DISTINCT source, split_part(text, chr(10), 1) AS t FROM documents) GROUP BY source")
def ded02(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    canonical = dd.best_per_key(raw, ["source", tq.first_line()], [F.length("text")], "doc_id")
    again = dd.best_per_key(raw.where("doc_id < 0").unionByName(canonical), ["source", tq.first_line()], [F.length("text")], "doc_id")
    return again.groupBy("source").agg(F.count("*").alias("n"))


@query("ded08_urls", "SELECT url, min(page_id) AS page_id FROM pages WHERE regexp_matches(url, '^https?://') GROUP BY url")
def ded08(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url").where(F.col("url").rlike("^https?://"))
    return pages.groupBy("url").agg(F.min("page_id").alias("page_id"))


@query("src05_pruned_edges", bq.W + bq.PAIRS + bq.EDGES + "SELECT a, b, weight FROM edges WHERE weight >= 40")
def src05(spark, sf_dir):
    path = new_path(spark, "edges-csv")
    records.write_columns(bq.keyword_edges(spark, sf_dir), path, ["a", "b", "weight", "paper_count"])
    return spark.read.csv(path, header=True, schema="a string, b string, weight double, paper_count long").select("a", "b", "weight").where("weight >= 40")


@query("src07_canonical_partitions", "SELECT source, CAST(lang AS VARCHAR) AS partition_year, count(*) AS n FROM documents WHERE source IN ('src1', 'src2') GROUP BY ALL")
def src07(spark, sf_dir):
    path = new_path(spark, "canonical")
    rows = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("partition_year"), F.col("doc_id").alias("record_key"))
    records.write_canonical(rows, path)
    return spark.read.json(path).where(F.col("source").isin("src1", "src2")).groupBy("source", "partition_year").agg(F.count("*").alias("n"))


@query("src12_sanitized", "SELECT conv_id, turn, length(text) AS n FROM conversations")
def src12(spark, sf_dir):
    return records.sanitized(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.length("text").alias("n"))


@query("src13_manifest", "SELECT source, count(*) AS records, count(*) FILTER (text IS NULL) AS invalid FROM documents GROUP BY source")
def src13(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("raw_file"), F.col("text").isNull().alias("invalid"), F.lit(2024).alias("y"))
    return records.manifest(rows, F.col("y")).select(F.col("raw_file").alias("source"), "records", "invalid")


@query("str05_session_memory", "WITH f AS (SELECT conv_id, lower(regexp_extract(text, '[a-zA-Z]+')) AS w, min(turn) AS t FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t DESC, w DESC) AS back FROM f WHERE w <> '') SELECT CAST(c.conv_id AS VARCHAR) AS session, coalesce(any_value(g.facts), '') AS facts FROM conversations c LEFT JOIN (SELECT conv_id, string_agg(w, ', ' ORDER BY t, w) AS facts FROM r WHERE back <= 12 GROUP BY conv_id) g ON g.conv_id = c.conv_id GROUP BY c.conv_id")
def str05(spark, sf_dir):
    stream = jobs.stream(spark, f"{sf_dir}/conversations.parquet").withColumn("fact", F.lower(F.regexp_extract("text", "[a-zA-Z]+", 0)))
    return jobs.drained(spark, jobs.session_memory(stream, "conv_id", "fact", "turn"), "memory", "update", ["session"])


@query("str06_resumed_vectors")
def str06(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    done = table(spark, sf_dir, "labels").select("doc_id")
    return ts.hashed_vectors(docs.join(done, "doc_id", "left_anti"), "doc_id", "text", 64).select("doc", F.size("vector").alias("size"))


@query("str07_ledger", "WITH p AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 300) SELECT p.doc_id, CASE WHEN b.text IS NULL THEN 'failed' WHEN len(regexp_split_to_array(trim(b.text), ' +')) < 30 THEN 'no_fulltext' ELSE 'enriched' END AS status FROM p LEFT JOIN benchmark b ON b.item_id = p.doc_id")
def str07(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    attempts = table(spark, sf_dir, "labels").select("doc_id", F.lit("failed").alias("status"))
    payloads = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return jobs.ledger(jobs.pending(docs, attempts, "doc_id", 300), payloads, "doc_id", "text", 30)


@query("mod04_nmf_topics")
def mod04(spark, sf_dir):
    return _factors(spark, sf_dir).words(8)


def _factors(spark, sf_dir):
    return tp.Factors.fit(*tp.tf_idf_rows(table(spark, sf_dir, "documents"), "doc_id", "text", stop=C.TERM_STOP), 4)


@query("mod04_paper_topics")
def mod04_papers(spark, sf_dir):
    return _factors(spark, sf_dir).topics()


@query("gra13_component_slices")
def gra13(spark, sf_dir):
    edges = stage(gq.sparse_edges(spark, sf_dir), "edges")
    return gr.component_slices(edges, connected_components(edges, "a", "b"))


@query("gra14_keyword_metrics")
def gra14(spark, sf_dir):
    edges = stage(bq.keyword_edges(spark, sf_dir), "edges")
    model = bq.trend_model(spark, sf_dir).select("keyword", "momentum", "lifecycle_stage", "hotness")
    measures = gr.weighted_degree(edges).join(gr.page_rank(edges).select("node", F.round("rank", 6).alias("page_rank")), "node")
    measures = measures.join(paths.weighted_betweenness(edges).select("node", F.round("betweenness", 6).alias("betweenness")), "node")
    measures = measures.join(gr.communities(edges), "node", "left").withColumnRenamed("node", "keyword")
    return model.join(measures, "keyword", "full_outer")


@query("rep01_manifest", bq.W + "SELECT 'documents' AS report, (SELECT count(*) FROM documents) AS n_rows UNION ALL SELECT 'keywords', (SELECT count(DISTINCT keyword) FROM doc_keywords) UNION ALL SELECT 'authors', (SELECT count(DISTINCT author) FROM doc_authors)")
def rep01(spark, sf_dir):
    count = lambda name, rows: rows.agg(F.lit(name).alias("report"), F.count("*").alias("n_rows"))
    tables = [
        count("documents", table(spark, sf_dir, "documents")), count("keywords", roles.doc_keywords(spark, sf_dir).select("keyword").distinct()),
        count("authors", roles.doc_authors(spark, sf_dir).select("author").distinct()), count("missing", table(spark, sf_dir, "documents").where("false")),
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.where("n_rows > 0")
