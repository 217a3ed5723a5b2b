"""One record for each key: arbitration, deletion plans, upserts."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalars import normal_doi, normal_title
from ..storage import stage
from .filters import clean_full_text, is_front_matter


def best_per_key(rows: DataFrame, keys: Sequence[Column | str], score: Sequence[Column], order: Column | str) -> DataFrame:
    """The row of highest (numeric) score for each key; the first in ``order`` among equals.

    An aggregate: each task passes on one row of a key, so a key that many rows share meets in few.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = rows.withColumns({n: F.col(k) if isinstance(k, str) else k for n, k in zip(names, keys, strict=True)})
    parts = [x for s in score for x in (s.isNull(), -s)] + [F.col(order) if isinstance(order, str) else order]
    place = F.struct(*[x.alias(f"o{i}") for i, x in enumerate(parts)])
    best = keyed.groupBy(*names).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), place).alias("__best"))
    return best.select("__best.*")


def first_per_key(rows: DataFrame, key: Column, order: Column | str) -> DataFrame:
    return best_per_key(rows, [key], [], order)


def corpus_key(title: Column, paper_id: Column, source: Column, long_title: int = 25) -> Column:
    """A long title, else a DOI, else source and id (the title where the id is blank)."""
    t, i = normal_title(title), F.lower(F.trim(F.coalesce(paper_id, F.lit(""))))
    own = F.when(i == "", t).otherwise(i)
    return (
        F.when(F.length(t) >= long_title, F.concat(F.lit("title:"), t)).when(i.startswith("10."), F.concat(F.lit("doi:"), i))
        .otherwise(F.concat(F.lit("source-id:"), F.trim(F.coalesce(source, F.lit(""))), F.lit(":"), own))
    )


def completeness(full_text: Column, abstract: Column, n_keywords: Column, n_authors: Column) -> list[Column]:
    """The record's score, most important part first."""
    return [
        F.when(F.length(clean_full_text(full_text)) > 200, 100).otherwise(0),
        F.least(F.floor(F.length(F.coalesce(abstract, F.lit(""))) / 100), F.lit(20)), n_keywords, F.least(n_authors, F.lit(10)),
    ]


def deletion_plan(rows: DataFrame, key: Column, score: Sequence[Column], order: str, title: str, row_id: str) -> DataFrame:
    """``row_id, reason`` of every row to delete: front matter first, then losers of their key."""
    front = rows.where(is_front_matter(F.col(title)))
    rest = rows.where(~is_front_matter(F.col(title)))
    losers = rest.join(best_per_key(rest, [key], score, order).select(row_id), row_id, "left_anti")
    return front.select(row_id, F.lit("front_matter").alias("reason")).union(losers.select(row_id, F.lit("duplicate").alias("reason")))


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """``target`` with ``updates`` merged by key; the highest ``version`` of a key wins, updates among equals."""
    both = target.withColumn("__u", F.lit(0)).unionByName(updates.withColumn("__u", F.lit(1)))
    rest = [c for c in target.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "__u")).alias("__v")).select(*keys, *[F.col(f"__v.{c}") for c in rest])


@F.pandas_udf(DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 where one title contains the other, else the ratio of matching characters."""
    same = lambda x, y: 1.0 if x and y and (x in y or y in x) else difflib.SequenceMatcher(None, x or "", y or "").ratio()
    return pd.Series([same(x, y) for x, y in zip(a, b, strict=True)])


def far_by_length(a: Column, b: Column, threshold: float) -> Column:
    """Whether two titles are unlike by their lengths and characters alone.

    Matching characters are at most those that both have, so the ratio of twice their number to both lengths bounds the
    similarity of titles of which neither contains the other.
    """
    letters = F.array_distinct(F.split(F.concat(a, b), ""))
    count = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    common = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda s, c: s + F.least(count(a, c), count(b, c)))
    bound = 2 * common / F.greatest(F.length(a) + F.length(b), F.lit(1))
    return ~F.contains(a, b) & ~F.contains(b, a) & (bound < threshold)


def clear_ambiguous_dois(rows: DataFrame, row_id: str, doi: str, title: str, source: str, sources: Sequence[str], threshold: float = 0.88) -> DataFrame:
    """Blank the DOI of ``sources``' rows wherever a DOI stands on two unlike titles.

    Distinct titles of a DOI are compared with its least and its shortest title first: by lengths and characters, then by matching
    runs. A DOI with an unlike pair is settled by one comparison for each title. Where all are like those, the rest of the pairs are
    compared, spread over tasks by pair.
    """
    keyed = rows.withColumn("__doi", F.nullif(normal_doi(F.col(doi)), F.lit(""))).withColumn("__t", normal_title(F.col(title)))
    titles = keyed.where("__doi is not null").select("__doi", "__t").distinct()
    ends = titles.groupBy("__doi").agg(F.min("__t").alias("__m"), F.min_by("__t", F.struct(F.length("__t"), "__t")).alias("__s"), F.count("*").alias("__n")).where("__n > 1")
    far = lambda a, b: far_by_length(F.col(a), F.col(b), threshold)
    quick = stage(titles.join(ends, "__doi").select("__doi", "__t", "__m", (far("__t", "__m") | far("__t", "__s")).alias("__far")), "titles")
    sure = quick.groupBy("__doi").agg(F.max("__far").alias("__far"))
    left = quick.join(sure.where("not __far").select("__doi"), "__doi", "left_semi")
    first = stage(left.select("__doi", "__t", (title_similarity("__t", "__m") < threshold).alias("__far")), "titles")
    found = first.groupBy("__doi").agg(F.max("__far").alias("__far"))
    open_ = first.join(found.where("not __far").select("__doi"), "__doi", "left_semi")
    pairs = open_.select("__doi", "__t").join(open_.select("__doi", F.col("__t").alias("__m")), "__doi").where("__t < __m")
    close = pairs.where(~far("__t", "__m")).repartition("__doi", "__t")
    later = pairs.where(far("__t", "__m")).select("__doi").union(close.where(title_similarity("__t", "__m") < threshold).select("__doi"))
    unlike = sure.where("__far").select("__doi").union(found.where("__far").select("__doi")).union(later).distinct().withColumn("__bad", F.lit(True))
    out = keyed.join(unlike, "__doi", "left").withColumn(doi, F.when(F.col("__bad") & F.col(source).isin(*sources), "").otherwise(F.col(doi)))
    return out.select(*rows.columns)


def suppress_seen(results: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results not shown before, each once."""
    return results.join(seen.select(*keys).distinct(), list(keys), "left_anti").dropDuplicates(list(keys))
