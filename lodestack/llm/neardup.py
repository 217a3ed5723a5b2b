"""Near-duplicate classes by an inverted join over MinHash signature coordinates.

Each document's set of word shingles gets a signature of ``COORDINATES`` independent values. Equal sets
are one class from the start, so only distinct sets are joined. A set is posted under each pair
(coordinate, value); values that no other set has are skipped. A coordinate's value joins ``WIDTH``
MinHash values, so unlike sets hardly ever share one. Two sets must agree in at least
``MATCHES`` coordinates: a set with fewer shared values can have no partner, and of one with c
shared values only the c - MATCHES + 1 rarest lists are merged, since two sets that agree so
often must meet there (prefix filtering in one global order, rare values first). The longer lists
are skipped: what a candidate pair has in common there is looked up in its signatures.

Merging never emits all pairs of a list:

* Every set meets a few *centres* of each of its lists. Collisions with them are counted, and
  the ``BEST`` centres of most collisions become candidates. Confirmed links are contracted to components.
* Lists that still hold several components leave their sets *open*. Open sets that are similar by the limit
  share one of their first shingles in the order of rarity among open sets, at places that their sizes
  bound (positional prefix filtering), so they are posted under these shingles by size. There they meet
  centres of other components once more; then all pairs of different components in a list become
  candidates, which takes only the list's members outside its largest component.

Candidates whose signatures agree in ``MATCHES`` coordinates are confirmed on full shingle sets. So no
link that could join two components is lost to centres, prefixes or sizes; a list has no limit.

A pair of similarity 0.8 agrees in each coordinate with probability 0.512, in 33 of 64 on average;
fewer than 16 has a probability of about 6e-6 (1e-9 at similarity 0.85), which is the only loss of the
method.

Null text, empty text and text without words have no shingles and are linked with nothing. Rows
with a null id cannot be named as anyone's partner and are returned as kept, without component.
Every repeated row is returned. Rows of one id with different texts are documents of their own: each has the component
of its own text, named by the least id in it (which two components may share then). A table without rows gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import discard, stage
from . import kernel as K

COORDINATES = 64
WIDTH = 3
MATCHES = 16
CENTRES = 3
#: Centres with which a set is compared, by collisions.
BEST = 4
#: Ratio of the sizes that one bucket of open sets spans.
RATIO = 1.03
_SLICE = 1 << 19

_rng = np.random.Generator(np.random.PCG64(9))
_MULTIPLY = _rng.integers(1, 1 << 63, (COORDINATES, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(text: K.Text, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each document's begin (one more)."""
    data = K.lowered(text.data)
    w = K.words(text)
    sums = K.sums_of(K.range_hashes(data, w.start, w.end))
    at = K.window_starts(w, size)
    doc, hashes = w.doc[at], K.span_hashes(sums, at, at + size)
    count = np.diff(w.first)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):  # the whole sequence is the one shingle
        doc = np.concatenate([doc, few])
        hashes = np.concatenate([hashes, K.span_hashes(sums, w.first[few], w.first[few + 1])])
    order = np.argsort(hashes)
    order = order[np.argsort(doc[order], kind="stable")]
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(len(text) + 1))


def _profiles(size: int):
    def run(batches):
        for batch in batches:
            for text in K.slices(batch.column(1), _SLICE):
                hashes, first = shingle_sets(text, size)
                n, full = np.diff(first), np.flatnonzero(np.diff(first))
                signature = np.zeros((len(text), COORDINATES), np.uint32)
                keys = np.zeros((2, len(text)), np.uint64)
                if len(full):
                    at = first[full]
                    for j in range(COORDINATES):
                        joined = np.zeros(len(at), np.uint64)
                        for factor in _MULTIPLY[j]:
                            joined = K.mix(joined + np.minimum.reduceat(hashes * factor, at))
                        signature[full, j] = joined >> np.uint64(32)
                    keys[0, full] = K.mix(np.add.reduceat(hashes, at))
                    keys[1, full] = K.mix(np.bitwise_xor.reduceat(K.mix(hashes), at))
                flat = pa.array(signature.view(np.int32).reshape(-1))
                steps = pa.array(np.arange(len(text) + 1, dtype=np.int32) * COORDINATES)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(text.first, len(text)) for k in (0, 2)),
                        pa.array(n.astype(np.int64)),
                        pa.array(keys[0].view(np.int64)),
                        pa.array(keys[1].view(np.int64)),
                        pa.ListArray.from_arrays(steps, flat),
                    ],
                    names=["doc_id", "version", "n", "key_a", "key_b", "signature"],
                )

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for text in K.slices(batch.column(1), _SLICE):
                hashes, first = shingle_sets(text, size)
                raw = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(text.first, len(text)), pa.array(raw, pa.binary())], names=["rep", "hashes"]
                )

    return run


def _shingles(batches):
    """rep, n, part, hashes -> a row for each hash."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(v.as_buffer()) // 8 for v in batch.column(3)])
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _SLICE, prepend=-1))
        for low, high in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
            part = batch.slice(low, high - low)
            times = pa.array(np.repeat(np.arange(high - low), sizes[low:high]))
            flat = np.frombuffer(b"".join(v.as_buffer() for v in part.column(3)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k).take(times) for k in range(3)), pa.array(flat)], names=["rep", "n", "part", "shingle"]
            )


def _confirm(numerator: int, denominator: int):
    def run(batches):
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked[i] = denominator * both >= numerator * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked))

    return run


class _Verifier:
    """Confirms candidate pairs of class representatives."""

    def __init__(self, classes: DataFrame, sets: DataFrame, percent: int):
        self.classes, self.sets, self.percent = classes, sets, percent

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a < b`` that agree in enough coordinates and are similar on full sets."""
        half = self.classes.select("rep", "signature")
        likely = (
            pairs.join(half.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a")
            .join(half.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
            .where(
                F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
                >= MATCHES
            )
            .select("a", "b")
        )
        return (
            likely.join(self.sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), "a")
            .join(self.sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), "b")
            .select("a", "b", "ha", "hb")
            .mapInArrow(_confirm(self.percent, 100), "a long, b long")
        )


def _to_centres(placed: DataFrame, keys: list[str], fits: Column, seed: int) -> DataFrame:
    """Pairs ``a, b`` of every set and those centres of its lists with which it collides most.

    ``placed`` has ``rep, n, part, place`` besides the lists' ``keys``; only pairs of different parts count
    that ``fits`` allows (on these columns, and ``m, spot`` of the centre). Centres are the members in whom the
    list's shingle comes first, for they have fewest shingles of their own, and one by hash.
    """
    member = ["rep", "n", "part", "place"]
    by_place = lambda k: F.when(F.lit(k + 1 < CENTRES), F.col("place"))
    ranked = [F.min(F.struct(by_place(k).alias("first"), F.xxhash64("rep", F.lit(seed + k)).alias("h"), *member)).alias(f"c{k}") for k in range(CENTRES)]
    centres = (
        placed.groupBy(*keys)
        .agg(F.min("part").alias("p"), F.max("part").alias("q"), *ranked)
        .where("p < q")
        .select(*keys, F.array_distinct(F.array(*[F.struct(*[f"c{k}.{x}" for x in member]) for k in range(CENTRES)])).alias("centres"))
    )
    collisions = (
        placed.join(centres, keys)
        .select(*member, F.explode("centres").alias("c"))
        .select(*member, F.col("c.rep").alias("other"), F.col("c.n").alias("m"), F.col("c.part").alias("apart"), F.col("c.place").alias("spot"))
        .where((F.col("part") != F.col("apart")) & fits)
        .groupBy("rep", "other")
        .agg(F.count("*").alias("collisions"))
    )
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("collisions"), "other"))
    best = collisions.withColumn("rank", rank).where(f"rank <= {BEST}")
    return best.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def _with_parts(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """``sets`` with the part of each ``rep``; a set without links is a part of its own."""
    named = parts.select(F.col("node").alias("rep"), F.col("component").alias("part"))
    return sets.join(named, "rep", "left").withColumn("part", F.coalesce("part", "rep"))


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` with the sets that had no link before put into the part of one that they are linked with."""
    ends = links.union(links.select("b", "a")).toDF("node", "other").join(parts.select("node"), "node", "left_anti")
    named = ends.join(parts.select(F.col("node").alias("other"), "component"), "other")
    return parts.union(named.groupBy("node").agg(F.min("component").alias("component")))


def _need(n: Column, m: Column, percent: int) -> Column:
    """Shingles that sets of ``n`` and ``m`` share at least if they are similar by the limit."""
    return F.ceil((n + m) * F.lit(percent / (100 + percent)) - 1e-6)


#: What makes a list of open sets: a shingle, and the size buckets of the two sets that may meet in it.
_LIST = ["shingle", "low", "high"]


def _posted(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``open_`` sets (``rep, n, part``) under their first shingles in the order of (frequency, hash), staged.

    Sets of n and m shingles are similar only if they share ``_need(n, m)``; then one of these is among the
    first n - need + 1 and m - need + 1. A set is posted once for each bucket of sizes that it may be similar to.
    """
    shingles = stage(open_.join(sets, "rep").select("rep", "n", "part", "hashes").mapInArrow(_shingles, "rep long, n long, part long, shingle long"), "shingles")
    lists = shingles.groupBy("shingle").agg(F.count("*").alias("df"), F.min("part").alias("p"), F.max("part").alias("q"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "shingle")) - 1
    bucket = lambda n: F.floor(F.log(n) / F.log(F.lit(RATIO)) + 1e-9).cast("int")
    n, share = F.col("n"), F.lit(percent / 100)
    posted = (
        shingles.join(lists, "shingle")
        .withColumn("place", place)
        .where((F.col("place") <= n - F.ceil(n * share - 1e-6)) & (F.col("p") < F.col("q")))
        .withColumn("own", bucket(n))
        .withColumn("their", F.explode(F.sequence(bucket(F.greatest(n * share, F.lit(1.0))), bucket(n / share))))
        .where(F.col("place") <= n - _need(n, F.pow(F.lit(RATIO), F.col("their")) - 0.5, percent))
        .select("shingle", F.least("own", "their").alias("low"), F.greatest("own", "their").alias("high"), "own", "their", "rep", "n", "place")
    )
    out = stage(posted, "posted")
    discard(shingles)
    return out


def _allowed(percent: int) -> Column:
    """Whether sets at ``place`` of ``n`` and at ``spot`` of ``m`` may be similar by the limit."""
    need = _need(F.col("n"), F.col("m"), percent)
    return (F.col("place") <= F.col("n") - need) & (F.col("spot") <= F.col("m") - need)


def _between_parts(posted: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different parts that share a list, with all that are similar by the limit.

    Of a list, the members outside its largest part meet all others; two of one part never meet.
    """
    main = posted.groupBy(*_LIST, "part").agg(F.count("*").alias("g")).groupBy(*_LIST).agg(F.max(F.struct("g", "part")).alias("main"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select(*_LIST, F.col("main.part").alias("main"))
    minor = posted.join(main, _LIST).where("part != main").select("shingle", "own", "their", "rep", "n", "part", "place")
    other = posted.select(
        "shingle", F.col("own").alias("their"), F.col("their").alias("own"), F.col("rep").alias("other"), F.col("n").alias("m"),
        F.col("part").alias("apart"), F.col("place").alias("spot"),
    )
    pairs = minor.join(other, ["shingle", "own", "their"]).where((F.col("part") != F.col("apart")) & _allowed(percent))
    return pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, version, head`` for every row of ``docs``.

    Rows are linked where 100 * |A and B| >= percent * |A or B| on their sets of ``shingle``-word
    shingles; a component's id is its least doc_id, whose row is kept. ``version`` is ``hash(text)``; ``head`` marks
    the text that stays if each component shall leave one text (of the least id, its version of least hash).
    """
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("version", F.hash("text"))
    profile = "doc_id long, version int, n long, key_a long, key_b long, signature array<int>"
    profiles = stage(given.mapInArrow(_profiles(shingle), profile), "profiles")
    named = profiles.where("n > 0 and doc_id is not null")
    first_of = F.min(F.struct("doc_id", "version")).alias("first")
    grouped = named.groupBy("key_a", "key_b", "n").agg(first_of, F.first("signature").alias("signature"))
    # classes are numbered; the numbers hold once the table is written
    classes = stage(grouped.select(F.monotonically_increasing_id().alias("rep"), "*"), "classes")
    key = (F.col("pos").cast("long") * (1 << 32)) + (F.col("value").cast("long") + (1 << 31))
    posts = classes.select("rep", "n", F.posexplode("signature").alias("pos", "value")).select("rep", "n", key.alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    mine = Window.partitionBy("rep")
    prefix = stage(
        posts.join(shared, "key")
        .withColumn("c", F.count("*").over(mine))
        .where(f"c >= {MATCHES}")
        .withColumn("rank", F.row_number().over(mine.orderBy("df", "key")))
        .where(f"rank <= c - {MATCHES} + 1")
        .select("key", "rep", "n"),
        "prefix",
    )
    wanted = classes.join(prefix.select("rep").distinct(), "rep", "left_semi").select("rep", "first.doc_id", "first.version")
    # equal rows count once
    texts = given.join(wanted, ["doc_id", "version"]).groupBy("doc_id", "version", "rep").agg(F.min("text").alias("text"))
    sets = stage(texts.select("rep", "text").mapInArrow(_sets(shingle), "rep long, hashes binary"), "sets")
    confirm = _Verifier(classes, sets, percent)
    fits = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & F.col("place").isNull()
    first = prefix.select("key", "rep", "n", F.col("rep").alias("part"), F.lit(None).cast("int").alias("place"))
    tried = stage(_to_centres(first, ["key"], fits, 0), "pairs")
    links = stage(confirm(tried), "links")
    parts = connected_components(links, "a", "b")
    placed = _with_parts(prefix, parts)
    several = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    posted = _posted(placed.join(several, "key").select("rep", "n", "part").distinct(), sets, percent)
    now = stage(_with_parts(posted, parts), "posted")
    again = stage(_to_centres(now, _LIST, _allowed(percent), CENTRES), "pairs")
    met = stage(confirm(again), "links")
    rest = stage(_between_parts(_with_parts(posted, _joined(parts, met)), percent), "pairs")
    last = stage(confirm(rest), "links")
    parts = connected_components(links.union(met).union(last), "a", "b")
    for table in (prefix, sets, tried, links, posted, now, again, met, rest, last):
        discard(table)
    lone = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key_a", "key_b", "n", "first", "component")
    lone = stage(lone, "components")
    heads = lone.where("component is not null").groupBy("component").agg(F.min("first").alias("head"))
    of_class = lone.where("component is not null").join(heads, "component").select("key_a", "key_b", "n", "head")
    of_class = of_class.union(lone.where("component is null").select("key_a", "key_b", "n", F.col("first").alias("head")))
    bare = profiles.select("doc_id", "version", "n", "key_a", "key_b")
    linked = bare.where("n > 0 and doc_id is not null").join(of_class, ["key_a", "key_b", "n"]).select("doc_id", "version", "n", "head")
    alone = bare.where("n = 0 or doc_id is null").select("doc_id", "version", "n", F.struct("doc_id", "version").alias("head"))
    found = linked.union(alone).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("head.doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("head.doc_id"), F.lit(True)).alias("kept"),
        "version",
        F.coalesce((F.col("doc_id") == F.col("head.doc_id")) & (F.col("version") == F.col("head.version")), F.lit(True)).alias("head"),
    )
    out = stage(found, "near-duplicates")
    for table in (profiles, classes, parts, lone):
        discard(table)
    return out
