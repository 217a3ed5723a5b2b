"""Queries with tables of terms, the taxonomy, evidence by phrases, weighted paths and what builds on them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import scalars as sc
from ..operators import dedupe as dd
from ..operators import evidence as ev
from ..operators import expansion as ex
from ..operators import graph as gr
from ..operators import brandes, normalize
from ..operators import search as se
from ..operators import terms as tm
from ..operators import textstats as ts
from ..operators import topics as tp
from ..storage import new_path, stage
from ..streaming import jobs, live
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


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- evidence

FIELD_SQL = {"title": tq.LINE, "keywords": "concat_ws(' ', lang, source)", "abstract": "split_part(text, chr(10), 2)", "full_text": "text"}
WORDS_SQL = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
GRAMS_SQL = "list_concat({0}, [{0}[i] || ' ' || {0}[i + 1] for i in range(1, len({0}))], [{0}[i] || ' ' || {0}[i + 1] || ' ' || {0}[i + 2] for i in range(1, len({0}) - 1)])"
POINTS_SQL = " ".join(
    f"WHEN field = '{f}' THEN {w} * CASE kind WHEN 'term' THEN 1 WHEN 'phrase' THEN {m} ELSE {2 * m} END" for f, (w, m) in L.FIELD_WEIGHTS.items()
)
EVIDENCE_SQL = (
    "WITH f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS field, {WORDS_SQL.format(s)} AS w FROM documents" for n, s in FIELD_SQL.items()) + "), "
    "hit AS (SELECT doc_id AS doc, field, unnest(list_distinct(" + GRAMS_SQL.format("w") + ")) AS gram FROM f), "
    "b AS (SELECT item_id AS query, " + WORDS_SQL.format("text") + " AS w FROM benchmark), "
    "asked AS (SELECT DISTINCT query, 'term' AS kind, unnest(w) AS gram FROM b UNION SELECT DISTINCT query, 'phrase', unnest((" + GRAMS_SQL.format("w") + ")[len(w) + 1:]) FROM b), "
    f"p AS (SELECT query, doc, gram, kind, CASE {POINTS_SQL} END AS points FROM hit JOIN asked USING (gram)), "
    "m AS (SELECT DISTINCT query, doc, kind, gram FROM p), s AS (SELECT query, doc, CAST(sum(points) AS BIGINT) AS score FROM p GROUP BY ALL), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s) "
    "SELECT r.query, r.doc, r.score, r.rank, md5(string_agg(m.gram, '|' ORDER BY m.kind, m.gram)) AS matches FROM r JOIN m ON m.query = r.query AND m.doc = r.doc WHERE r.rank <= 3 GROUP BY ALL"
)


@query("ret08_phrase_evidence", EVIDENCE_SQL)
def ret08_phrases(spark, sf_dir):
    lines = lambda k: F.split_part(F.col("text"), F.lit("\n"), F.lit(k))
    fields = {"title": lines(1), "keywords": F.concat_ws(" ", "lang", "source"), "abstract": lines(2), "full_text": F.col("text")}
    best = ev.best_evidence_of(table(spark, sf_dir, "documents"), "doc_id", fields, table(spark, sf_dir, "benchmark"), "item_id", "text")
    return best.select("query", "doc", "score", "rank", F.md5(F.array_join("matches", "|").cast("binary")).alias("matches"))


# ---- terms

#: A dictionary from the data: the first word and the first two words of each benchmark item, by its number.
TERM_SQL = "b AS (SELECT item_id, " + tq.SQ.format("text") + " AS t FROM benchmark), g AS (SELECT string_split(t, ' ')[1] AS term, 'first' || item_id AS name FROM b UNION ALL SELECT string_split(t, ' ')[1] || ' ' || string_split(t, ' ')[2], 'both' || item_id FROM b), k AS (SELECT term, min(name) AS name FROM g WHERE term <> '' GROUP BY term)"


def item_terms(spark, sf_dir):
    words = F.split(sc.squeezed(F.col("text")), " ")
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    one = items.select(F.get("w", F.lit(0)).alias("term"), F.concat(F.lit("first"), "item_id").alias("name"))
    two = items.select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("term"), F.concat(F.lit("both"), "item_id").alias("name"))
    return one.union(two)


@query(
    "joi11_bilingual",
    "WITH " + TERM_SQL + r""", p AS (SELECT string_agg(regexp_escape(term), '|' ORDER BY length(term) DESC, term) AS pattern, map(list(term), list(name)) AS names FROM k),
    d AS (SELECT doc_id, text, regexp_extract_all(text, pattern) AS hits, names, regexp_split_to_array(text, pattern) AS parts FROM documents, p WHERE text IS NOT NULL),
    j AS (SELECT doc_id, text, hits, array_to_string([parts[i] || CASE WHEN i <= len(hits) THEN ' ' || names[hits[i]] || ' ' ELSE '' END for i in range(1, len(parts) + 1)], '') AS t FROM d)
    SELECT doc_id, len(hits) AS n_terms, md5(CASE WHEN len(hits) > 0 THEN """ + tq.SQ.format("t") + """ ELSE text END) AS digest FROM j""",
)
def joi11_bilingual(spark, sf_dir):
    names = tm.dictionary(item_terms(spark, sf_dir), "term", "name")
    docs = table(spark, sf_dir, "documents").where("text is not null")
    hits = F.regexp_count("text", F.lit(tm.trie_pattern(names))).cast("long")
    return docs.select("doc_id", hits.alias("n_terms"), F.md5(tm.replaced(F.col("text"), names, None).cast("binary")).alias("digest"))


#: Normalised texts as for keywords, less the aliases that are for whole keywords.
NORMAL_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(" + tq.SQ.format("coalesce({0}, '')") + r"), '_', ' '), '[-/]+', ' ', 'g'), '[^a-z0-9 +#]', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))"


def normal_sql(text: str) -> str:
    n = NORMAL_SQL.format(text)
    return f"CASE WHEN length({n}) > 4 AND {n} LIKE '%ies' THEN {n}[1:-4] || 'y' WHEN length({n}) > 4 AND {n} LIKE '%s' AND {n} NOT LIKE '%ss' THEN {n}[1:-2] ELSE {n} END"


#: Concepts over the texts' own frequent words, besides the fixed table.
COMMON = {"articles": ("the", "le", "la", "der", "die"), "copula": ("it is", "is a", "es de"), "of the": ("of the", "de la", "de le")}


def _concept_sql(table_) -> str:
    one = lambda phrases: "|".join(r"\b" + re.escape(p).replace(r"\ ", " ") + r"\b" for p in phrases)
    cases = ", ".join(f"CASE WHEN regexp_matches(n, {quoted(one(p))}) THEN {quoted(name)} END" for name, p in sorted(table_.items()))
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ';')"


@query("sca15_signals", f"WITH n AS (SELECT doc_id, {normal_sql('text')} AS n FROM documents) SELECT doc_id, {_concept_sql(L.CONCEPT_PHRASES | COMMON)} AS concepts FROM n")
def sca15_signals(spark, sf_dir):
    found = tm.concepts_of(sc.normal_keyword(F.col("text")), L.CONCEPT_PHRASES | COMMON)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ";").alias("concepts"))


@query(
    "sca15_concept_table",
    "WITH b AS (SELECT item_id, regexp_extract_all(" + normal_sql("text") + ", '[a-z0-9]+|[+#]') AS w FROM benchmark), k AS (SELECT w[1] || ' ' || w[2] AS phrase, item_id AS concept FROM b WHERE len(w) > 1 UNION SELECT w[3], item_id FROM b WHERE len(w) > 2), "
    "n AS (SELECT doc_id, regexp_extract_all(" + normal_sql("text") + ", '[a-z0-9]+|[+#]') AS w FROM documents), g AS (SELECT DISTINCT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS phrase FROM n) "
    "SELECT concept, count(DISTINCT doc_id) AS docs FROM g JOIN k ON k.phrase = g.phrase GROUP BY concept",
)
def sca15_table(spark, sf_dir):
    parts = F.regexp_extract_all(sc.normal_keyword(F.col("text")), F.lit("[a-z0-9]+|[+#]"), F.lit(0))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("concept"), parts.alias("w"))
    two = items.where("size(w) > 1").select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("phrase"), "concept")
    phrases = two.union(items.where("size(w) > 2").select(F.get("w", F.lit(2)), "concept"))
    rows = tm.concept_rows(table(spark, sf_dir, "documents"), "doc_id", sc.normal_keyword(F.col("text")), phrases, (1, 2))
    return rows.groupBy("concept").agg(F.count_distinct("doc").alias("docs"))


#: Filler of the given texts' languages, after the fixed lists.
MORE_FILLER = ("of the", "the", "de la", "und", "a")


def _filler_sql(text: str) -> str:
    for f in L.CHINESE_FILLER:
        text = f"replace({text}, {quoted(f)}, ' ')"
    edge = r"[^\p{L}\p{N}_]"  # this dialect's word boundary knows a-z alone; neighbours share an edge, so two passes
    for f in (*L.ENGLISH_FILLER, *MORE_FILLER):
        for _ in range(2):
            text = f"regexp_replace({text}, {quoted(f'(^|{edge}){f}({edge}|$)')}, '\\1 \\2', 'gi')"
    return tq.SQ.format(text)


@query(
    "sca17_clean_questions",
    "WITH q AS (SELECT conv_id, turn, text, " + _filler_sql("text") + " AS c FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE WHEN length(c) >= 2 THEN c ELSE text END AS question, "
    "coalesce(regexp_matches(lower(text), " + quoted("|".join(L.RECENCY_WORDS)) + "), false) AS recent, coalesce(regexp_matches(text, '[一-鿿]'), false) AS chinese FROM q",
)
def sca17(spark, sf_dir):
    turns, text = table(spark, sf_dir, "conversations").where("role = 'user'"), F.col("text")
    clean = tm.without_filler(text, english=(*L.ENGLISH_FILLER, *MORE_FILLER))
    return turns.select("conv_id", "turn", clean.alias("question"), tm.wants_recent(text).alias("recent"), tm.has_chinese(text).alias("chinese"))


# ---- taxonomy: parts stand for papers, with categories, subjects and keywords from their own columns

CODES = ("cs.AI", "cs.XX", "q-bio.GN", "math.CO", "hep-th", "", "stat.ML", "cond-mat.soft", "eess.IV", "unknown.1")
SOURCES = ("openalex", "arxiv", "doaj", "pubmed", "core")
HEADS = ("Computer networks", "Public  Health", "genetics", "Chemical technology", "Mathematics", "Law", "Poetry", "")
SEEDS = ("medicine", "", "poetry", "materials science")


def _pick_sql(values, by: str) -> str:
    return f"[{', '.join(map(quoted, values))}][1 + {by} % {len(values)}]"


def _rule_sql(joined: str, first: str, then: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({joined}), {quoted('|'.join(parts))}) THEN [{quoted(d)}, {quoted(f)}, {first}]" for parts, d, f in L.SUBJECT_RULES)
    return f"CASE {cases} ELSE {then} END"


_CLEAN = tq.SQ.format("{0}")
_CROSS = "['Cross-field', 'Unknown', '']"
_BY_SEED = _rule_sql("s0", _CLEAN.format("s0"), _CROSS)
_CAT = (
    "CASE " + " ".join(f"WHEN lower(code) = '{c}' THEN ['{t[0]}', '{t[1]}', '{t[2]}']" for c, t in L.CATEGORY_TAXA.items())
    + " " + " ".join(f"WHEN split_part(lower(code), '.', 1) = '{a}' THEN ['{t[0]}', '{t[1]}', code]" for a, t in L.ARCHIVE_TAXA.items()) + " ELSE ['Physical Sciences', 'Physics', code] END"
)
TAXONOMY_SQL = (
    "WITH p AS (SELECT p_partkey, " + _pick_sql(SOURCES, "p_partkey") + " AS source, " + _pick_sql(CODES, "p_size") + " AS code, " + _pick_sql(HEADS, "p_size") + " AS head, "
    + _pick_sql(SEEDS, "(p_partkey // 5)") + " AS seed, lower(p_type) AS fld, string_split(p_name, ' ') AS kw, CASE WHEN p_size % 3 > 0 THEN p_type ELSE '' END AS tdomain, CASE WHEN p_size % 4 > 0 THEN p_brand ELSE '' END AS tfield, CASE WHEN p_size % 5 > 0 THEN p_name ELSE '' END AS tsub FROM part), "
    "k AS (SELECT *, CASE WHEN seed <> '' THEN seed ELSE fld END AS s0, coalesce(list_filter(kw, lambda x: length(x) >= 4)[1], '') AS ksub FROM p), "
    f"b AS (SELECT *, {_BY_SEED} AS bs, {_rule_sql('head', _CLEAN.format('head'), _rule_sql('seed', _CLEAN.format('seed'), _CROSS))} AS hs, {_CAT} AS cs, list_filter([tsub, tdomain, tfield, tsub], lambda x: x <> '') AS tt FROM k), "
    "r AS (SELECT *, CASE source WHEN 'openalex' THEN [tdomain, tfield, tsub] WHEN 'arxiv' THEN cs WHEN 'doaj' THEN hs WHEN 'pubmed' THEN CASE WHEN bs[1] = 'Cross-field' THEN ['Health Sciences', 'Medicine', ksub] ELSE [bs[1], bs[2], ksub] END ELSE bs END AS t, "
    "CASE source WHEN 'openalex' THEN tt WHEN 'arxiv' THEN list_filter([code], lambda x: x <> '') WHEN 'doaj' THEN list_filter([" + _CLEAN.format("head") + "], lambda x: x <> '') WHEN 'pubmed' THEN kw ELSE list_filter([seed, fld], lambda x: x <> '') END AS terms FROM b) "
    "SELECT p_partkey, CASE WHEN t[1] = '' OR t[2] = '' THEN bs[1] ELSE t[1] END AS domain, CASE WHEN t[1] = '' OR t[2] = '' THEN bs[2] ELSE t[2] END AS field, "
    "CASE WHEN t[3] <> '' THEN t[3] WHEN (t[1] = '' OR t[2] = '') AND bs[3] <> '' THEN bs[3] ELSE ksub END AS subfield, "
    "CASE source WHEN 'openalex' THEN 'openalex_primary_topic' WHEN 'arxiv' THEN 'arxiv_category' WHEN 'doaj' THEN 'doaj_subject' WHEN 'pubmed' THEN 'biomedical_keywords' ELSE 'field_seed' END AS taxonomy_source, "
    "CASE source WHEN 'openalex' THEN CASE WHEN len(terms) > 0 THEN 0.95 ELSE 0.55 END WHEN 'arxiv' THEN CASE WHEN len(terms) > 0 THEN 0.9 ELSE 0.55 END WHEN 'doaj' THEN CASE WHEN len(terms) > 0 THEN 0.82 ELSE 0.55 END WHEN 'pubmed' THEN CASE WHEN len(terms) > 0 THEN 0.75 ELSE 0.6 END ELSE 0.55 END::DOUBLE AS taxonomy_confidence, "
    "array_to_string(terms, ';') AS raw_taxonomy_terms FROM r"
)


@query("sca16_taxonomy_rules", TAXONOMY_SQL)
def sca16_rules(spark, sf_dir):
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), by % len(values))
    when = lambda k, c: F.when(F.col("p_size") % k > 0, F.col(c)).otherwise("")
    topic = F.struct(when(5, "p_name").alias("name"), when(3, "p_type").alias("domain"), when(4, "p_brand").alias("field"), when(5, "p_name").alias("subfield"))
    size, key = F.col("p_size").cast("int"), F.col("p_partkey").cast("int")
    none = F.array().cast("array<string>")
    taxon = tm.taxonomy(
        pick(SOURCES, key), topic, F.array(pick(CODES, size)), F.array(pick(HEADS, size)), none, pick(SEEDS, F.floor(key / 5).cast("int")), F.lower("p_type"), F.split("p_name", " ")
    )
    return table(spark, sf_dir, "part").select("p_partkey", taxon.alias("t")).select("p_partkey", "t.*")


# ---- graph measures over the graph that grows with the data

_SUPPLIERS = "WITH " + roles.BASKETS_SQL + gq.SPARSE + gq.BOTH


@query("gra03_weighted_betweenness")
def gra03_weighted(spark, sf_dir):
    """Of suppliers that share orders, from all of them, with 1/weight as length; tests hold it against Dijkstra's algorithm."""
    return brandes.normalized(gq.sparse_edges(spark, sf_dir)).select("node", F.round("betweenness", 6).alias("betweenness"))


@query(
    "gra02_supplier_rank",
    _SUPPLIERS + ", outs AS (SELECT node, sum(weight) AS out FROM both_ways GROUP BY node), nn AS (SELECT count(*) AS n FROM outs), r0 AS (SELECT node, 1.0 / n AS rank FROM outs, nn)" + gq._RANKS + " SELECT node, round(rank, 6) AS rank FROM r30",
)
def gra02_suppliers(spark, sf_dir):
    return gr.page_rank(stage(gq.sparse_edges(spark, sf_dir), "edges")).select("node", F.round("rank", 6).alias("rank"))


# ---- topics over the years: market segments stand for topics

YEARS = list(range(roles.YEAR_START - 5, roles.YEAR_END + 1))
_POINTS = ", ".join(f"(topic, {y}, y{y}::DOUBLE)" for y in YEARS[:-1])


@query(
    "win10_topic_trends",
    "WITH " + roles.BASKETS_SQL + ", w AS (SELECT field AS topic, " + ", ".join(f"count(*) FILTER (year = {y}) AS y{y}" for y in YEARS) + " FROM docs WHERE year BETWEEN " + f"{YEARS[0]} AND {YEARS[-1]}" + " GROUP BY field), "
    "p AS (SELECT topic, unnest([" + ", ".join(f"{{'x': {y}::DOUBLE, 'y': y{y}::DOUBLE}}" for y in YEARS[:-1]) + "]) AS p FROM w), "
    "f AS (SELECT topic, regr_slope(p.y, p.x) AS slope, min(p.y) AS lo, max(p.y) AS hi, arg_max(p.y, p.x) AS last, arg_min(p.y, p.x) AS first FROM p GROUP BY topic), "
    "s AS (SELECT a.topic, round(median((b.p.y - a.p.y) / (b.p.x - a.p.x)), 8) AS sen FROM p a JOIN p b ON a.topic = b.topic AND a.p.x < b.p.x GROUP BY a.topic), "
    "kw AS (SELECT field AS topic, keyword, count(*) AS n FROM doc_keywords GROUP BY ALL), kr AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, keyword) AS r FROM kw), ks AS (SELECT topic, string_agg(keyword, '; ' ORDER BY r) AS words FROM kr WHERE r <= 5 GROUP BY topic) "
    "SELECT w.*, " + f"CAST({YEARS[-2] + 1} AS INTEGER) AS next_year, greatest(0.0, round(CASE WHEN hi - lo <= 1e-8 + 1e-5 * abs(first) THEN last ELSE last + 0.5 * CASE WHEN sen <> 0 THEN sen ELSE slope END END, 6)) AS forecast, "
    "round(CASE WHEN hi - lo <= 1e-8 + 1e-5 * abs(first) THEN 0.0 ELSE slope END, 8) AS trend_slope, ks.words FROM w JOIN f ON f.topic = w.topic JOIN s ON s.topic = w.topic LEFT JOIN ks ON ks.topic = w.topic",
)
def win10_trends(spark, sf_dir):
    docs = roles.baskets(spark, sf_dir).select("doc_id", "year", F.col("field").alias("topic")).distinct()
    shares = docs.groupBy("topic", "year").agg(F.count("*").alias("papers"))
    words = roles.doc_keywords(spark, sf_dir).groupBy(F.col("field").alias("topic"), "keyword").agg(F.count("*").alias("n"))
    ranked = words.groupBy("topic").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "keyword"))), 1, 5).alias("k"))
    return tp.topic_trends(shares.where(F.col("year").isin(YEARS)), ranked.select("topic", F.array_join("k.keyword", "; ").alias("words")), YEARS)


# ---- streams

LIVE_SQL = "WITH e AS (SELECT event_type AS claim, user_id AS paper, CASE event_id % 3 WHEN 0 THEN 'SUPPORT' WHEN 1 THEN 'CONTRADICT' ELSE 'NEUTRAL' END AS stance, event_id AS seen FROM events), s AS (SELECT claim, paper, arg_max(stance, seen) AS stance, max(seen) AS seen FROM e GROUP BY ALL) "


def event_stances(events):
    """Events as stances of users on event types; a user's later event takes back what an earlier one said."""
    stance = F.when(F.col("event_id") % 3 == 0, "SUPPORT").when(F.col("event_id") % 3 == 1, "CONTRADICT").otherwise("NEUTRAL")
    return events.select(F.col("event_type").alias("claim"), F.col("user_id").alias("paper"), stance.alias("stance"), F.col("event_id").alias("seen"))


@query("str04_live_contradictions", LIVE_SQL + "SELECT claim, count(*) FILTER (stance = 'SUPPORT') AS support, count(*) FILTER (stance = 'CONTRADICT') AS contradict, count(*) AS papers, max(seen) AS last_seen FROM s GROUP BY claim HAVING support > 0 AND contradict > 0")
def str04_live(spark, sf_dir):
    stream = event_stances(jobs.stream(spark, f"{sf_dir}/events.parquet"))
    return live.disputed(live.live_contradictions(spark, stream, new_path(spark, "contradictions")).table())


@query("str06_resumable_vectors", "SELECT doc_id AS chunk, CAST(1 AS BIGINT) AS times, 64 AS size FROM documents")
def str06_resumable(spark, sf_dir):
    """The stream is read twice, the second time without knowing of the first: each text has its vector once."""
    path = new_path(spark, "vectors")
    chunks = lambda: jobs.stream(spark, f"{sf_dir}/documents.parquet", 1).select(F.col("doc_id").alias("chunk"), "text")
    encode = lambda rows: ts.hashed_vectors(rows, "chunk", "text", 64).withColumnRenamed("doc", "chunk")
    for mark in ("first", "second"):
        done = live.resumable_vectors(spark, chunks(), path, "hashed64", encode, f"{path}/checkpoint-{mark}")
    return done.groupBy("chunk").agg(F.count("*").alias("times"), F.max(F.size("vector")).alias("size"))


# ---- questions about parts, expanded by what is ordered together with them

QUESTION_SQL = "q AS (SELECT p_partkey AS question, 'What about ' || upper(p_name) || ' or the ' || p_brand || '?' AS text FROM part WHERE p_partkey % 100 = 0)"


@query(
    "ret09_question_expansion",
    "WITH " + roles.BASKETS_SQL + ", " + QUESTION_SQL + ", ids AS (SELECT DISTINCT doc_id AS paper, keyword FROM doc_names), "
    + r"w AS (SELECT question, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM q), g AS (SELECT DISTINCT question, unnest(" + GRAMS_SQL.format("w") + ") AS low FROM w), "
    "seeds AS (SELECT DISTINCT question, keyword FROM g JOIN (SELECT DISTINCT keyword FROM ids) k ON lower(k.keyword) = g.low), "
    "sp AS (SELECT DISTINCT question, paper FROM seeds JOIN ids USING (keyword)), n AS (SELECT question, keyword, count(*) AS n FROM sp JOIN ids USING (paper) WHERE (question, keyword) NOT IN (SELECT question, keyword FROM seeds) GROUP BY ALL), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY n DESC, keyword) AS INTEGER) AS rank FROM n) SELECT * FROM r WHERE rank <= 8",
)
def ret09_questions(spark, sf_dir):
    asked = table(spark, sf_dir, "part").where("p_partkey % 100 = 0")
    text = F.concat(F.lit("What about "), F.upper("p_name"), F.lit(" or the "), "p_brand", F.lit("?"))
    papers = roles.doc_names(spark, sf_dir).select("doc_id", "keyword").distinct()
    seeds = stage(ex.named_keywords(asked.select(F.col("p_partkey").alias("question"), text.alias("text")), "question", "text", papers, "keyword"), "seeds")
    return ex.neighbours(seeds, papers, "doc_id", "keyword", 8)


# ---- lines of documents as chunks, ranked by themselves, each document once

CHUNK_SQL = (
    r"WITH ch AS (SELECT doc_id * 1000000 + i - 1 AS chunk, doc_id AS paper, lines[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), range(1, len(lines) + 1) AS t(i)), "
    r"post AS (SELECT term, doc, count(*) AS tf FROM (SELECT chunk AS doc, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM ch) GROUP BY term, doc), "
    "terms AS" + tq.LEX.split(", terms AS", 1)[1] + ", l AS (SELECT * FROM lex WHERE rank <= 400), b AS (SELECT l.query, ch.paper, min(l.rank) AS r FROM l JOIN ch ON ch.chunk = l.doc GROUP BY ALL), "
    "o AS (SELECT b.query, b.paper, l.doc AS chunk, l.score, CAST(row_number() OVER (PARTITION BY b.query ORDER BY b.r) AS INTEGER) AS rank FROM b JOIN l ON l.query = b.query AND l.rank = b.r) SELECT * FROM o WHERE rank <= 40"
)


@query("ret01_chunk_rank", CHUNK_SQL)
def ret01_chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    chunks = lines.select((F.col("doc_id") * 1_000_000 + F.col("i")).alias("chunk"), F.col("doc_id").alias("paper"), "text")
    terms = se.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    ranked = stage(se.ranked_texts(chunks, "chunk", "text", terms, 400, se.repeats(table(spark, sf_dir, "documents"), "doc_id")), "ranked")
    return ex.best_chunks(ranked, chunks, "chunk", "paper", 40)


# ---- records

@query("ded02_history", "SELECT source, count(*) AS n, CAST(sum(d) AS BIGINT) AS ids FROM (SELECT source, arg_min(doc_id, (-length(text), doc_id)) AS d FROM documents WHERE text IS NOT NULL GROUP BY source, split_part(text, chr(10), 1)) GROUP BY source")
def ded02_history(spark, sf_dir):
    """What even ids left is history; odd ids land on it and are arbitrated together with it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text").where("text is not null")
    key = ["source", tq.first_line()]
    history = stage(dd.best_per_key(rows.where("doc_id % 2 = 0"), key, [F.length("text")], "doc_id"), "history")
    both = dd.best_per_key(history.unionByName(rows.where("doc_id % 2 = 1")), key, [F.length("text")], "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(
    "nrm15_provenance",
    "SELECT o_orderkey, CASE WHEN y <= 1998 THEN y END AS year, y AS original_year, CASE WHEN y > 1998 THEN 'future_year_suspect' ELSE 'ok' END AS year_status, "
    "CASE WHEN y > 1998 THEN 'future_year_suspect' ELSE coalesce(CAST(y AS VARCHAR), 'unknown') END AS partition_year, o_orderpriority || ' ' || o_orderpriority || ' ' || o_orderstatus AS text_for_analysis "
    "FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)",
)
def nrm15(spark, sf_dir):
    papers = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("abstract"), F.year("o_orderdate").alias("year"))
    return normalize.with_provenance(papers, 1998).drop("title", "abstract")


def _plain_sql(text: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, {quoted(entity)}, {quoted(char)})"
    return tq.SQ.format(f"regexp_replace({text}, '<[^>]+>', ' ', 'g')")


@query(
    "nrm13_body_parts",
    r"WITH b AS (SELECT page_id, regexp_extract(coalesce(html, ''), '(?s)<article(?:\s[^>]*)?>(.*)</article>', 1) AS inner_ FROM pages), "
    r"p AS (SELECT page_id, list_filter([" + _plain_sql("x") + r" for x in regexp_extract_all(inner_, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1)], lambda t: t <> '') AS t FROM b) "
    "SELECT page_id, len(t) AS paragraphs, md5(array_to_string(t, ' ')[1:2500]) AS excerpt FROM p",
)
def nrm13_body(spark, sf_dir):
    parts = table(spark, sf_dir, "pages").select("page_id", sc.body_parts(F.col("html"), "article", ()).alias("parts"))
    return parts.select("page_id", F.size("parts").cast("long").alias("paragraphs"), F.md5(sc.body_excerpt(F.col("parts")).cast("binary")).alias("excerpt"))
