"""Reading raw scholarly records and writing governed tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The wrapper around every raw record; the payload stays text until its source's schema is applied.
WRAPPER = "source string, source_id string, query string, field_seed string, crawled_at string, raw string"


def numbered_lines(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*") -> DataFrame:
    """``value, raw_file, line_number``: the lines of text files, numbered from 1 within their file.

    Lines are counted in each part of a file that a task reads; the counts of the parts before it, one row a part, are
    broadcast. So the numbers are the same however files are split.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(paths if isinstance(paths, str) else list(paths))
    part = ["raw_file", "part"]
    placed = lines.select("value", F.col("_metadata.file_path").alias("raw_file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"))
    parts = placed.groupBy(*part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("raw_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(*part, (before - F.col("first") + 1).alias("shift"))
    return placed.join(F.broadcast(starts), part).select("value", "raw_file", (F.col("at") + F.col("shift")).alias("line_number"))


def read_wrappers(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.jsonl") -> DataFrame:
    """Wrapper rows with ``raw_file``, ``line_order`` (the line's number in its file) and ``invalid``; blank lines are skipped.

    A line that is not a JSON object with a source gives an invalid row instead of an error.
    """
    lines = numbered_lines(spark, paths, pattern).where(F.trim("value") != "")
    part = lambda name: F.get_json_object("value", f"$.{name}")
    names = [f.split()[0] for f in WRAPPER.split(", ")]
    rows = lines.select("raw_file", F.col("line_number").alias("line_order"), *[part(n).alias(n) for n in names])
    return rows.withColumn("invalid", F.col("source").isNull() | F.col("raw").isNull())


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Papers from a JSON array or a CSV file with a header; other suffixes raise ValueError."""
    if path.endswith(".json"):
        return spark.read.json(path, multiLine=True)
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    raise ValueError(f"neither .json nor .csv: {path}")


def read_chunks(spark: SparkSession, path: str, schema: str, chunk_types: Sequence[str]) -> DataFrame:
    return spark.read.schema(schema).json(path).where(F.col("chunk_type").isin(*chunk_types))


def manifest(wrappers: DataFrame, year: Column) -> DataFrame:
    """Records, invalid lines and observed years of every file."""
    return wrappers.groupBy("raw_file").agg(
        F.count("*").alias("records"), F.count_if("invalid").alias("invalid"), F.array_sort(F.collect_set(year)).alias("years")
    )


def sanitized(rows: DataFrame) -> DataFrame:
    """NUL characters dropped from all text columns."""
    return rows.withColumns({c: F.translate(F.col(f"`{c}`"), "\u0000", "") for c, kind in rows.dtypes if kind == "string"})


def write_canonical(rows: DataFrame, path: str, keys: Sequence[str] = ("source", "partition_year"), order: str = "record_key") -> None:
    """One folder for each source and year, replacing the whole table, so no old partition survives."""
    rows.repartition(*keys, F.pmod(F.xxhash64(order), F.lit(16))).sortWithinPartitions(*keys, order).write.mode("overwrite").partitionBy(*keys).json(path)


def write_columns(rows: DataFrame, path: str, columns: Sequence[str], kind: str = "csv") -> None:
    writer = rows.select(*columns).write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.format(kind).save(path)


def replace_if_not_smaller(new: DataFrame, path: str) -> int:
    """Replace the Parquet table at ``path`` only by at least as many rows; returns the rows it then has.

    The new rows are written beside it first and renamed into place.
    """
    spark = new.sparkSession
    beside = f"{path}-{uuid.uuid4().hex}"
    new.write.parquet(beside)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there, fresh = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside))
    files = there.getFileSystem(conf)
    n_new = spark.read.parquet(beside).count()
    n_old = spark.read.parquet(path).count() if files.exists(there) else -1
    if n_new < n_old:
        files.delete(fresh, True)
        return n_old
    files.delete(there, True)
    files.rename(fresh, there)
    return n_new


def quota_sample(rows: DataFrame, query: str, key: str, limit: int, n_queries: int, backfill: DataFrame | None = None) -> DataFrame:
    """At most ceil(limit / queries) rows of each query, each key once, topped up to ``limit`` from ``backfill``."""
    quota = -(-limit // n_queries)
    once = rows.where(F.trim(key) != "").dropDuplicates([key])
    picked = once.withColumn("__r", F.row_number().over(Window.partitionBy(query).orderBy(key))).where(F.col("__r") <= quota).drop("__r")
    if backfill is None:
        return picked
    more = backfill.where(F.trim(key) != "").dropDuplicates([key]).join(picked.select(key), key, "left_anti").select(*rows.columns)
    return picked.withColumn("__p", F.lit(0)).unionByName(more.withColumn("__p", F.lit(1))).orderBy("__p", key).limit(limit).drop("__p")


_PERSONS = "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>"
_IDS = "array<struct<_{0}:string,_VALUE:string>>"
#: The parts of an article record that are read; ids in its reference list lie elsewhere.
ARTICLE_XML = (
    "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,"
    f"ELocationID:{_IDS.format('EIdType')},Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string>>>,{_PERSONS}>>,"
    f"PubmedData struct<ArticleIdList:struct<ArticleId:{_IDS.format('IdType')}>>"
)


def read_article_xml(spark: SparkSession, path: str) -> DataFrame:
    """``pmid, title, abstract, authors, year, journal, doi`` of stored XML batches of article records.

    The DOI is the electronic location's, else the record's own id, never one of a cited article; an
    empty text where there is neither.
    """
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE_XML).load(path)
    article = F.col("MedlineCitation.Article")
    doi_in = lambda ids, kind: F.get(F.transform(F.filter(ids, lambda i: i[kind] == "doi"), lambda i: F.trim(i["_VALUE"])), F.lit(0))
    names = F.transform(article["AuthorList"]["Author"], lambda a: F.concat_ws(" ", a["ForeName"], a["LastName"]))
    return rows.select(
        F.col("MedlineCitation.PMID").alias("pmid"), article["ArticleTitle"].alias("title"), F.array_join(article["Abstract"]["AbstractText"], " ").alias("abstract"),
        F.coalesce(names, F.array().cast("array<string>")).alias("authors"), article["Journal"]["JournalIssue"]["PubDate"]["Year"].alias("year"), article["Journal"]["Title"].alias("journal"),
        F.coalesce(doi_in(article["ELocationID"], "_EIdType"), doi_in(F.col("PubmedData.ArticleIdList.ArticleId"), "_IdType"), F.lit("")).alias("doi"),
    )


def read_feed_xml(spark: SparkSession, path: str) -> DataFrame:
    """``id, title, summary, authors, published, categories`` of stored Atom batches."""
    schema = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return rows.select("id", F.trim("title").alias("title"), F.trim("summary").alias("summary"), F.col("author.name").alias("authors"), "published", F.col("category._term").alias("categories"))


def text_candidates(source: Column, doi: Column, pmcid: Column, url: Column, paper_id: Column) -> Column:
    """Addresses where a paper's full text may be, with the reason, most direct first; each address once, http(s) only."""
    one = lambda when, address, reason: F.when(when, F.struct(address.alias("url"), F.lit(reason).alias("reason")))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    listed = F.array_compact(
        F.array(
            one(has(pmcid), F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmcid, F.lit("/")), "pmc"),
            one(source == "arxiv", F.concat(F.lit("https://arxiv.org/pdf/"), paper_id), "preprint"),
            one(has(url), url, "given"),
            one(has(doi), F.concat(F.lit("https://doi.org/"), doi), "doi"),
        )
    )
    web = F.filter(listed, lambda x: x["url"].rlike("^https?://"))
    return F.filter(web, lambda x, i: ~F.exists(F.slice(web, F.lit(1), i), lambda y: y["url"] == x["url"]))
