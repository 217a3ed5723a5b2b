"""Column expressions over names, keywords, ids and texts. Null gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C

SPACE = r"[\x20\x09-\x0D]+"


def squeezed(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normal_title(title: Column) -> Column:
    """Lower-cased and squeezed; null gives the empty text."""
    return F.lower(squeezed(F.coalesce(title, F.lit(""))))


def stable_uid(*parts: Column) -> Column:
    """SHA-1 of the parts, each lower-cased and squeezed, joined by U+241F; null counts as empty."""
    return F.sha1(F.concat_ws("\u241f", *[normal_title(p.cast("string")) for p in parts]).cast("binary"))


def paper_uid(source: Column, source_id: Column, paper_id: Column, title: Column, year: Column) -> Column:
    known = F.coalesce(F.nullif(F.trim(source_id), F.lit("")), F.nullif(F.trim(paper_id), F.lit("")))
    return F.when(known.isNotNull(), stable_uid(F.lit("paper"), source, known)).otherwise(stable_uid(F.lit("paper"), title, year))


def author_uid(name: Column) -> Column:
    return stable_uid(F.lit("author"), name)


def keyword_uid(keyword: Column) -> Column:
    return stable_uid(F.lit("keyword"), keyword)


def author_key(author_id: Column, orcid: Column, name: Column) -> Column:
    """Id, else ORCID, else the name with everything but letters and digits turned to single spaces."""
    plain = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    return F.coalesce(F.nullif(author_id, F.lit("")), F.nullif(orcid, F.lit("")), F.concat(F.lit("name:"), plain))


def normal_keyword(text: Column) -> Column:
    """Letters, digits, + and # in lower case; singular; known aliases replaced. Null gives the empty text."""
    t = F.lower(squeezed(F.coalesce(text, F.lit(""))))
    t = F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("_"), F.lit(" ")), "[-/]+", " "), "[^a-z0-9 +#]", " ")
    t = F.trim(F.regexp_replace(t, SPACE, " "))
    aliases = F.create_map(*[F.lit(x) for pair in C.KEYWORD_ALIASES.items() for x in pair])

    def singular(t: Column) -> Column:
        n = F.length(t)
        return (
            F.when((n > 4) & t.endswith("ies"), F.concat(F.substr(t, F.lit(1), n - 3), F.lit("y")))
            .when((n > 4) & t.endswith("s") & ~t.endswith("ss"), F.substr(t, F.lit(1), n - 1))
            .otherwise(t)
        )

    # each step is computed once, however often the next one names it
    return bound(bound(t, singular), lambda t: F.coalesce(F.try_element_at(aliases, t), t))


def tokens_words(text: Column) -> Column:
    """Runs of letters and digits plus CJK characters, at least 1 for a text that is not empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.regexp_count(t, F.lit("[A-Za-z0-9]+")) + F.regexp_count(t, F.lit("[\u4e00-\u9fff]"))
    return F.when(t == "", 0).otherwise(F.greatest(F.lit(1), n))


def tokens_chars(text: Column) -> Column:
    """CJK characters at 1.5 and all others at 4 to a token, rounded down."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(t, F.lit("[\u4e00-\u9fff]"))
    return F.floor(cjk / 1.5 + (F.length(t) - cjk) / 4.0)


def without_markup(text: Column) -> Column:
    """Common entities resolved, tags dropped, white space squeezed."""
    t = text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return squeezed(F.regexp_replace(t, "<[^>]+>", " "))


def body_parts(xml: Column, within: str = "body", titles: tuple[str, ...] = ("title",), paragraphs: tuple[str, ...] = ("p",)) -> Column:
    """The titles and paragraphs of a nested article in their order, as ``array<struct<kind, text>>`` of ``title`` and ``paragraph``.

    The first ``within`` element counts, to its last end; sections may be nested at will. Texts are without markup; blank ones are
    left out. Without such an element, and for null, the array is empty.
    """
    inner = F.regexp_extract(F.coalesce(xml, F.lit("")), rf"(?s)<{within}(?:\s[^>]*)?>(.*)</{within}>", 1)
    pattern = rf"(?s)<({'|'.join((*titles, *paragraphs))})(?:\s[^>]*)?>(.*?)</\1>"
    names, texts = (F.regexp_extract_all(inner, F.lit(pattern), F.lit(k)) for k in (1, 2))
    kind = lambda n: F.when(n.isin(*titles), "title").otherwise("paragraph") if titles else F.lit("paragraph")
    parts = F.zip_with(names, texts, lambda n, t: F.struct(kind(n).alias("kind"), without_markup(t).alias("text")))
    return F.filter(parts, lambda x: x["text"] != "")


def body_excerpt(parts: Column, size: int = 2500) -> Column:
    """The first ``size`` characters of the paragraphs."""
    return F.substring(F.array_join(F.transform(F.filter(parts, lambda x: x["kind"] == "paragraph"), lambda x: x["text"]), " "), 1, size)


def page_text(html: Column) -> Column:
    """Text of a page without scripts, styles, navigation, headers, footers, asides, forms and comments."""
    t = html
    for tag in ("script", "style", "nav", "header", "footer", "aside", "form"):
        t = F.regexp_replace(t, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    t = F.regexp_replace(t, "(?s)<!--.*?-->", " ")
    return squeezed(F.regexp_replace(t, "<[^>]+>", " "))


def without_latex(text: Column) -> Column:
    """Comments, floats and commands dropped; the titles of sections stay as text."""
    t = F.regexp_replace(text, r"(?m)(?<!\\)%.*$", "")
    t = F.regexp_replace(t, r"(?s)\\begin\{(figure|table|equation|align)\*?\}.*?\\end\{\1\*?\}", " ")
    t = F.regexp_replace(t, r"\\(?:sub)*section\*?\{([^}]*)\}", " $1. ")
    t = F.regexp_replace(t, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^}]*\})?", " ")
    return squeezed(F.regexp_replace(t, r"[{}$]", " "))


def normal_doi(doi: Column) -> Column:
    """Lower case, without resolver address and prefix."""
    return F.regexp_replace(F.lower(F.trim(doi)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))


def first_year(text: Column) -> Column:
    """First 19xx or 20xx in the text, as a number."""
    return F.nullif(F.regexp_extract(text, r"((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def variant_key(keyword: Column) -> Column:
    """Sorted singular tokens, so that word order and plurals do not matter."""
    t = F.trim(F.regexp_replace(F.lower(keyword), "[^a-z0-9]+", " "))
    one = lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.array_join(F.array_sort(F.transform(F.split(t, " "), one)), " ")


def normal_claim(text: Column) -> Column:
    """Digits, letters of the Latin alphabet and CJK characters, in lower case, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9\u4e00-\u9fff]+", " "))


def concepts(text: Column, patterns: dict[str, str]) -> Column:
    """Names of all patterns that a text matches, in the table's order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()]))


def snippet(text: Column, title: Column, size: int) -> Column:
    """The first ``size`` characters after a leading title."""
    t = F.trim(text)
    return F.substring(F.when((title != "") & F.startswith(t, title), F.trim(F.substr(t, F.length(title) + 1))).otherwise(t), 1, size)


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used, also for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_grams(words: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` words, joined by spaces."""
    n = F.size(words)

    def runs(k: int) -> Column:
        starts = F.sequence(F.lit(1), n - k + 1)
        return F.when(n >= k, F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(k) for k in range(low, high + 1)])


def expanded(text: Column, terms: dict[str, str]) -> Column:
    """Terms of a dictionary replaced, the longest first, each by its translation between spaces; squeezed."""
    out = text
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        out = F.replace(out, F.lit(term), F.lit(f" {terms[term]} "))
    return squeezed(out)


def bib_entry(key: Column, title: Column, authors: Column, year: Column) -> Column:
    """One BibTeX article entry; authors are an array of names."""
    return F.concat(F.lit("@article{"), key, F.lit(",\n  title = {"), title, F.lit("},\n  author = {"), F.array_join(authors, " and "), F.lit("},\n  year = {"), year.cast("string"), F.lit("}\n}"))


def without_nan(value: Column) -> Column:
    """Null where a number is not one."""
    return F.when(~F.isnan(value), value)


def record_hash(columns: list[str]) -> Column:
    """sha1 of the record as JSON with its fields in order of name, nulls written out."""
    record = F.struct(*[F.col(f"`{c}`") for c in sorted(columns)])
    return F.sha1(F.to_json(record, {"ignoreNullFields": "false"}).cast("binary"))


def payload(rows: DataFrame, keep: tuple[str, ...], whole: tuple[str, ...] = ()) -> DataFrame:
    """The columns in ``keep`` that exist: NaN as null, and those in ``whole`` as integers."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema}
    clean = lambda c: without_nan(F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
    return rows.select(*[(clean(c).cast("long") if c in whole else clean(c)).alias(c) for c in keep if c in kinds])
