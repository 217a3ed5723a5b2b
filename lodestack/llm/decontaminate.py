"""Benchmark decontamination by size-partitioned MinHash containment, with DataFrame functions alone.

An item is contained in a document if at least ``percent`` per cent of its distinct word shingles
occur there. Items are partitioned by size: class c holds those of up to 2**c shingles. A class
keeps a bottom-k MinHash sketch of each item, with k one more than the most shingles that a contained
item of the class may lack. At least one sketch value of a contained item therefore occurs in the
document (and k less what this item may lack, in general), so the search loses nothing. Documents
with fewer shingles than an item needs are not its candidates. Candidate pairs are then verified by
counting all of the item's shingles, as strings of words, in the document.

Words are runs without space and 0x09-0x0D, with A-Z lowered. An item of fewer words than a shingle is one shingle
of its own length, and documents have shingles of such lengths too where items ask for them. Texts without words, null
texts and rows with a null id match nothing. Items
with the same id are one item; documents with the same id are one document. Without items or without
documents there are no rows; other columns of either table, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stage
from .common import WORD

#: Most rows of a side that is broadcast after being counted; beyond it the join shuffles.
BROADCAST_ROWS = 300_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingled(table: DataFrame, key: str, text: str, size: int, hashed: bool = True, shorter: tuple[int, ...] = (), whole: bool = False) -> DataFrame:
    """``key, shingles``: all distinct runs of ``size`` words, as 64-bit hashes or as they are.

    ``shorter`` lengths are added; ``whole`` makes a text of fewer words one run.
    """
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER)
    words = F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    given = table.select(F.col(key), (F.transform(words, lambda w: F.xxhash64(w)) if hashed else words).alias("w"))
    none = F.array().cast("array<bigint>" if hashed else "array<string>")

    def runs(length: int) -> Column:
        part = lambda i: [F.get(F.col("w"), i + k) for k in range(length)]
        window = (lambda i: F.xxhash64(*part(i))) if hashed else (lambda i: F.concat_ws(" ", *part(i)))
        return F.when(F.size("w") >= length, F.transform(F.sequence(F.lit(0), F.size("w") - length), window)).otherwise(none)

    every = F.concat(*map(runs, (size, *shorter))) if shorter else runs(size)
    if whole:
        for length in range(1, size):
            every = F.when(F.size("w") == length, runs(length)).otherwise(every)
    return given.select(key, F.array_distinct(every).alias("shingles"))


def _exploded(table: DataFrame, *columns: Column | str) -> DataFrame:
    """A row for each shingle. (explode() would let the optimizer test the array before it is computed, again
    for each word; explode_outer() does not.)"""
    return table.select(*columns, F.explode_outer("shingles").alias("shingle")).where("shingle is not null")


def _small(table: DataFrame) -> DataFrame:
    """``table``, marked for broadcast if it is small enough."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _lacking(n: Column, percent: int) -> Column:
    """Most shingles of ``n`` that a contained item may lack."""
    return F.floor(n * (100 - percent) / 100).cast("int")


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment`` of every document that contains an item."""
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null")
    tests = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).where("item_id is not null")
    known = shingled(tests, "item_id", "text", size, whole=True).groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("shingles")))).alias("shingles"))
    n = F.size("shingles")
    bound = F.pow(F.lit(2), F.ceil(F.log2(n)))
    known = known.where(n > 0).select(
        "item_id", "shingles", n.alias("n_item"), (_lacking(bound, percent) + 1).alias("k"), _lacking(n, percent).alias("lacking")
    )
    known = stage(known, "items")
    n_words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
    shorter = tuple(r.n for r in tests.select(n_words.alias("n")).where(f"n between 1 and {size - 1}").distinct().orderBy("n").collect())
    sketch = known.select("item_id", "n_item", F.least("k", "n_item").alias("k"), "lacking", F.explode(F.slice("shingles", F.lit(1), F.col("k"))).alias("shingle"))
    found = shingled(given, "doc_id", "text", size, shorter=shorter)
    hits = (
        _exploded(found, "doc_id", F.size("shingles").alias("n_doc"))
        .join(_small(sketch), "shingle")
        .where("n_doc >= n_item - lacking")
    )
    pairs = (
        hits.groupBy("doc_id", "item_id", "k", "lacking").agg(F.count_distinct("shingle").alias("hits")).where("hits >= k - lacking").select("doc_id", "item_id")
    )
    pairs = stage(pairs, "candidates")
    ids = pairs.select("doc_id").distinct()
    again = _exploded(shingled(given.join(_small(ids), "doc_id", "left_semi"), "doc_id", "text", size, False, shorter), "doc_id")
    full = _exploded(shingled(tests, "item_id", "text", size, False, whole=True), "item_id").distinct().join(known.select("item_id", "n_item", "lacking"), "item_id")
    shared = again.join(_small(full), "shingle").join(_small(pairs), ["doc_id", "item_id"], "left_semi")
    found = (
        shared.groupBy("doc_id", "item_id", "n_item", "lacking")
        .agg(F.count_distinct("shingle").alias("n_shared"))
        .where("n_shared >= n_item - lacking")
        .select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )
    out = stage(found, "contained")
    discard(known)
    discard(pairs)
    return out


#: DuckDB SQL for contaminated() on ``documents`` and ``benchmark``, by counting without any search.
ORACLE = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark
), short AS (SELECT DISTINCT len(w) AS m FROM words WHERE kind = 1 AND len(w) BETWEEN 1 AND 4
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS s FROM words, range(1, greatest(len(w) - 3, 1)) AS r(i) WHERE len(w) >= 5
  UNION
  SELECT kind, id, array_to_string(w[i : i + m - 1], ' ') FROM words, short, range(1, greatest(len(w) - m + 2, 1)) AS r(i) WHERE (kind = 0 AND len(w) >= m) OR (kind = 1 AND len(w) = m)
), sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, z.n AS n_item, count(*) AS n_shared, count(*) / z.n AS containment
FROM shingles d JOIN shingles b ON d.s = b.s AND d.kind = 0 AND b.kind = 1 JOIN sizes z ON z.id = b.id
GROUP BY d.id, b.id, z.n HAVING 100 * count(*) >= 80 * z.n
"""
