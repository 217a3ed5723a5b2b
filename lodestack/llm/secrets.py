"""Secret scan with DataFrame functions alone.

Three base patterns find assignments, access keys and hexadecimal runs. Then every other run of
key-like characters is a candidate: a window of ``WINDOW`` characters slides over it with the counts of
its characters. One character leaves and one enters, which changes two counts and two terms of the Shannon
entropy; windows above the limit of the run's character class make a further span. Runs that the allow
list knows (UUIDs, alphabets, digits or letters alone, placeholders) and runs that touch a base span are
passed over.

All steps take time in proportion to the text, whatever the length of a run; n matches are placed in
about n ** 1.5 steps and compared with base spans by bisection. Texts are never cut.

Places are code points, ends exclusive. Null text counts as empty: no spans. Repeated rows and equal ids
are rows of their own; spans that begin at one place are ordered by kind. A table without rows gives
none. There is no shuffle: a document's spans come from its own row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, without

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Classes of runs, the first that fits a whole run, and bits a character that its windows must reach.
CLASSES = (("hexadecimal", "^[0-9a-fA-F]+$", 3.0), ("one case", "^([0-9a-z]+|[0-9A-Z]+)$", 3.5), ("mixed", "", 3.8))
ALLOWED = (
    r"^[0-9]+$|^[A-Za-z+/_=-]+$"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|(?i:example|sample|placeholder|dummy|xxxxx|0123456789|abcdefghij|qwerty)"
)
_KINDS = ("assign", "access", "hex", "entropy")
_SPANS = "array<struct<start:long,rank:int,end:long,body:string>>"
#: Counts of a window's characters, five bits each, twelve to a long; "+" is the first key-like character.
_FIRST, _BITS, _FIELDS, _LONGS = ord("+"), 5, 12, 7
#: c * log2(c) in fixed point, so that sums of changes stay exact.
_ONE = 1 << 32
_TERMS = [round(c * math.log2(c) * _ONE) if c else 0 for c in range(WINDOW + 1)]


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), 0)


def _placed(matches: Column, rank: int) -> Column:
    """Spans of ``matches`` (structs of the gap before, the length and the body) from left to right.

    Running sums are taken in blocks of about the square root of their number, then over the blocks.
    """
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + m["size"]).alias("end"), m["body"].alias("body"))
        return F.struct((start + m["size"]).alias("at"), F.concat(state["out"], F.array(span).cast(_SPANS)).alias("out"))

    def blocks(all_: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(all_))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(1), F.size(all_), width), lambda i: F.aggregate(F.slice(all_, i, width), zero, step))

    none = F.array().cast(f"array<struct<base:long,out:{_SPANS}>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("blocks"))
    based = F.aggregate(
        _bound(matches, blocks),
        start,
        lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["blocks"], F.array(F.struct(s["at"].alias("base"), b["out"].alias("out")))).alias("blocks")),
        lambda s: s["blocks"],
    )
    moved = lambda b: F.transform(b["out"], lambda m: F.struct((m["start"] + b["base"]).alias("start"), m["rank"].alias("rank"), (m["end"] + b["base"]).alias("end"), m["body"].alias("body")))
    return F.flatten(F.transform(based, moved))


def _located(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """Spans of all matches, with a group's text as the body; the texts between matches tell their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("all"), body.alias("body"))
    sized = F.transform(
        F.filter(rows, lambda r: r["all"].isNotNull()),
        lambda r: F.struct(F.length(r["gap"]).cast("long").alias("gap"), F.length(r["all"]).cast("long").alias("size"), r["body"].alias("body")),
    )
    return F.when(text.rlike(pattern), _placed(sized, rank)).otherwise(F.array().cast(_SPANS))


def _touches(spans: Column, run: Column) -> Column:
    """Whether one of ``spans`` (disjoint, from left to right) shares a character with ``run``; by bisection."""
    n = F.size(spans)

    def step(before: Column, half: Column) -> Column:
        probe = F.get(spans, before + half - 1)["start"]
        return F.when((before + half <= n) & (probe < run["end"]), before + half).otherwise(before)

    halves = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    steps = F.filter(halves, lambda h: h <= n)
    last = F.aggregate(steps, F.lit(0), step)  # spans that begin before the run's end
    return F.when(n > 0, F.coalesce(F.get(spans, last - 1)["end"] > run["start"], F.lit(False))).otherwise(F.lit(False))


def _change(state: Column, code: Column, by: int) -> Column:
    """The window's counts and entropy sum with one character more or less."""
    field, shift = F.call_function("div", code, F.lit(_FIELDS)), (code % _FIELDS) * _BITS
    terms = F.array(*[F.lit(t) for t in _TERMS])
    count = F.call_function("shiftright", F.get(state["counts"], field.cast("int")), shift).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
    unit = F.call_function("shiftleft", F.lit(by).cast("long"), shift)
    counts = F.transform(state["counts"], lambda x, k: F.when(k == field, x + unit).otherwise(x))
    return F.struct(counts.alias("counts"), (state["sum"] + F.get(terms, count + by) - F.get(terms, count)).alias("sum"))


def high_windows(run: Column, limit: Column) -> Column:
    """First and last window of ``run`` (0-based starts) whose entropy reaches ``limit``; null where none does.

    Entropy is log2(W) - S / W, S being the sum of c * log2(c) over the window's character counts c.
    """
    none = F.lit(None).cast("int")
    codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.ascii(c) - _FIRST)
    most = F.floor((F.lit(math.log2(WINDOW)) - limit) * (WINDOW * _ONE)) + WINDOW  # and what rounding may add

    def slide(given: Column) -> Column:
        code, most = given["code"], given["most"]

        def mark(s: Column, i: Column, low: Column, high: Column) -> Column:
            hit = s["sum"] <= most
            return F.struct(
                s["counts"].alias("counts"), s["sum"].alias("sum"), F.coalesce(low, F.when(hit, i)).alias("low"), F.when(hit, i).otherwise(high).alias("high")
            )

        def step(state: Column, i: Column) -> Column:
            out, in_ = F.get(code, i - 1), F.get(code, i + (WINDOW - 1))
            moved = F.when(out == in_, F.struct(state["counts"].alias("counts"), state["sum"].alias("sum"))).otherwise(
                _bound(_change(state, out, -1), lambda s: _change(s, in_, 1))
            )
            return _bound(moved, lambda s: mark(s, i, state["low"], state["high"]))

        zero = F.struct(F.array(*[F.lit(0).cast("long")] * _LONGS).alias("counts"), F.lit(0).cast("long").alias("sum"))
        first = F.aggregate(F.slice(code, 1, WINDOW), zero, lambda s, c: _change(s, c, 1))
        start = _bound(first, lambda s: mark(s, F.lit(0), none, none))
        slides = F.when(F.size(code) > WINDOW, F.sequence(F.lit(1), F.size(code) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(slides, start, step, lambda s: F.when(s["low"].isNotNull(), F.struct(s["low"].alias("low"), s["high"].alias("high"))))

    return _bound(F.struct(codes.alias("code"), most.alias("most")), slide)


def _limit(run: Column) -> Column:
    limit = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        limit = F.when(run.rlike(pattern), F.lit(bits)).otherwise(limit)
    return limit


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans``: structs of start, rank (of assign, access, hex, entropy), end, body.

    A column of that name is replaced.
    """
    body, base, runs = fresh_name(docs, "body"), fresh_name(docs, "base"), fresh_name(docs, "runs")
    kept = without(docs, "secret_spans").columns
    given = docs.withColumn(body, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    t = F.col(body)
    assign = F.filter(_located(t, ASSIGN, 0, 1), lambda m: F.length(m["body"]) >= 8)
    access = F.when(F.contains(t, F.lit("AKIA")), _located(t, ACCESS, 1)).otherwise(F.array().cast(_SPANS))
    given = given.withColumn(base, F.struct(assign.alias("assign"), access.alias("access"), _located(t, HEX, 2).alias("hex")))
    kinds = [F.col(base)[k] for k in ("assign", "access", "hex")]

    def free(m: Column) -> Column:
        return ~m["body"].rlike(ALLOWED) & ~_touches(kinds[0], m) & ~_touches(kinds[1], m) & ~_touches(kinds[2], m)

    given = given.withColumn(runs, F.filter(_located(t, CANDIDATE, 3), free))
    judged = F.transform(F.col(runs), lambda m: F.struct(m.alias("m"), high_windows(m["body"], _limit(m["body"])).alias("w")))
    added = F.transform(
        F.filter(judged, lambda j: j["w"].isNotNull()),
        lambda j: F.struct(
            (j["m"]["start"] + j["w"]["low"]).cast("long").alias("start"), F.lit(3).alias("rank"),
            (j["m"]["start"] + j["w"]["high"] + WINDOW).cast("long").alias("end"),
            F.substr(j["m"]["body"], j["w"]["low"] + 1, j["w"]["high"] - j["w"]["low"] + WINDOW).alias("body"),
        ),
    )
    added = F.when(F.size(runs) > 0, added.cast(_SPANS)).otherwise(F.array().cast(_SPANS))
    spans = F.array_sort(F.concat(*kinds, added))
    return given.withColumn("secret_spans", spans).select(*[F.col(f"`{c}`") for c in kept], "secret_spans")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    one = lambda m: F.concat_ws(":", F.get(kinds, m["rank"]), m["start"].cast("string"), m["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
