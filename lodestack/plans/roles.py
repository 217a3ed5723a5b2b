"""The given tables in the roles that the operators expect, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import FEW, dealt, few
from ..tables import table

YEAR_START, YEAR_END = 1997, 2001

#: SQL of the same views, to stand before an oracle's own query.
BASKETS_SQL = """
baskets AS (
  SELECT l.l_orderkey AS doc_id, p.p_brand AS keyword, p.p_name AS name, l.l_suppkey AS author, l.l_linenumber AS position,
         CAST(year(o.o_orderdate) AS INTEGER) AS year, c.c_mktsegment AS field, o.o_orderpriority AS source
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey JOIN customer c ON o.o_custkey = c.c_custkey),
doc_keywords AS (SELECT DISTINCT doc_id, keyword, year, field, source FROM baskets),
doc_names AS (SELECT DISTINCT doc_id, name AS keyword, year FROM baskets),
doc_authors AS (SELECT doc_id, author, year, field, CAST(min(position) AS INTEGER) AS position FROM baskets GROUP BY ALL),
docs AS (SELECT DISTINCT doc_id, year, field, source FROM baskets)
"""


def size(spark: SparkSession, sf_dir: str) -> int:
    """Order lines, by which joins and pairs are dealt out."""
    return table(spark, sf_dir, "lineitem").count()


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line: document, keyword, author and their attributes."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    n = size(spark, sf_dir)  # all sides of a join are dealt alike
    lines = dealt(lines, n, "l_partkey").join(dealt(parts, n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    orders = dealt(orders, n, "o_custkey").join(dealt(customers, n, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = dealt(lines, n, "l_orderkey").join(dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("l_orderkey").alias("doc_id"), F.col("p_brand").alias("keyword"), F.col("p_name").alias("name"),
        F.col("l_suppkey").alias("author"), F.col("l_linenumber").alias("position"), F.year("o_orderdate").alias("year"),
        F.col("c_mktsegment").alias("field"), F.col("o_orderpriority").alias("source"),
    )


def doc_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets(spark, sf_dir).select("doc_id", "keyword", "year", "field", "source").distinct()


def doc_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets(spark, sf_dir).select("doc_id", F.col("name").alias("keyword"), "year").distinct()


def doc_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets(spark, sf_dir).groupBy("doc_id", "author", "year", "field").agg(F.min("position").alias("position"))


def order_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, author`` of the order lines of ``baskets``, with repeats.

    As the other tables give no column, their keys only select: parts and customers are broadcast if few, and lines are
    shuffled by their order alone, by which they can be grouped next.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = size(spark, sf_dir)

    def having(rows, key, name, its):
        keys = table(spark, sf_dir, name).select(its)
        small = few(keys, 4 * FEW)
        sides = (rows, small) if small is not keys else (dealt(rows, n, key), dealt(keys, n, its))
        return sides[0].join(sides[1], F.col(key) == F.col(its), "left_semi")

    lines, orders = having(lines, "l_partkey", "part", "p_partkey"), having(orders, "o_custkey", "customer", "c_custkey")
    kept = dealt(lines, n, "l_orderkey").join(dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return kept.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("author"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
