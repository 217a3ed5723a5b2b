"""Tables of terms applied to texts in one pass: replacement, concepts, filler, and the taxonomy cascade."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.scalars import bound, n_grams, normal_keyword, squeezed

CJK = "[一-鿿]"


def trie_pattern(terms: Iterable[str]) -> str:
    """A regular expression that finds, at each place, the longest of ``terms`` that begins there.

    The terms form a trie: a beginning that several share is tried once, so the cost of a place doesn't grow with the
    number of terms. Empty terms don't count; without any, nothing matches.
    """
    trie: dict = {}
    for term in terms:
        node = trie
        for letter in term:
            node = node.setdefault(letter, {})
        if term:
            node[""] = {}

    def spelled(node: dict) -> str:
        ways = [re.escape(letter) + spelled(below) for letter, below in sorted(node.items()) if letter]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return body + ("?" if "" in node else "")

    # recursion is as deep as the longest term; a term's end has no letters below it
    return spelled(trie) or r"(?!)"


def _literal_map(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def replaced(text: Column, terms: Mapping[str, str], only_with: str | None = CJK) -> Column:
    """Terms replaced by their translations between spaces, and white space squeezed; all in one pass from the left.

    At each place the longest term wins, and translations are not translated again. Texts without a term, and those
    without ``only_with`` (a pattern; None asks for nothing), stay exactly as they are. Null stays null.
    """
    if not terms:
        return text
    pattern = trie_pattern(terms)
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    names = _literal_map(terms)
    spaced = bound(names, lambda m: F.transform(hits, lambda t: F.concat(F.lit(" "), F.try_element_at(m, t), F.lit(" "))))
    # one piece more than hits
    joined = F.array_join(F.zip_with(between, spaced, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    due = F.size(hits) > 0
    if only_with is not None:
        due = due & text.rlike(only_with)
    return F.when(due, squeezed(joined)).otherwise(text)


def dictionary(table: DataFrame, term: str, translation: str, most: int = 20_000) -> dict[str, str]:
    """A table of terms as a mapping; of several translations the least counts. Raises ValueError beyond ``most`` terms, which is the
    size of table that fits into a plan."""
    rows = table.where(F.col(term) != "").groupBy(F.col(term).alias("t")).agg(F.min(translation).alias("r")).where("r is not null")
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} terms")
    return {r.t: r.r for r in found}


#: Tokens of a normalised text; + and # stand between words, so words with one between them are no neighbours.
_PART = "[a-z0-9]+|[+#]"


def _grams(text: Column, sizes: Iterable[int]) -> Column:
    parts = F.regexp_extract_all(text, F.lit(_PART), F.lit(0))
    return bound(parts, lambda w: F.array_distinct(F.concat(*[n_grams(w, k, k) for k in sorted(set(sizes))])))


def concepts_of(text: Column, table: Mapping[str, Iterable[str]] = L.CONCEPT_PHRASES) -> Column:
    """Names of all concepts of which a phrase stands in the normalised ``text``, in order of name.

    The text's runs of words are looked up among the phrases, so the text is read once, however many concepts there are.
    """
    of = {p: tuple(sorted(n for n, phrases in table.items() if p in phrases)) for phrases in table.values() for p in phrases}
    if not of:
        return F.array().cast("array<string>")
    hits = F.array_intersect(_grams(text, (len(p.split()) for p in of)), F.array(*map(F.lit, of)))
    names = F.create_map(*[x for p, n in of.items() for x in (F.lit(p), F.array(*map(F.lit, n)))])
    return bound(names, lambda m: F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.try_element_at(m, h))))))


def concept_rows(docs: DataFrame, doc: str, text: Column, phrases: DataFrame, sizes: Iterable[int], few: int = 100_000) -> DataFrame:
    """``doc, concept`` for a table of phrases (``phrase, concept``) of any size; ``sizes`` are its phrases' lengths in words.

    The phrases travel to the texts if they are ``few``, counted first; else runs of words are shuffled to the phrases.
    """
    runs = docs.select(F.col(doc).alias("doc"), F.explode_outer(_grams(text, sizes)).alias("phrase"))
    table = phrases.select("phrase", "concept").distinct()
    known = F.broadcast(table) if table.limit(few + 1).count() <= few else table
    return runs.join(known, "phrase").select("doc", "concept").distinct()


def without_filler(query: Column, chinese: Iterable[str] = L.CHINESE_FILLER, english: Iterable[str] = L.ENGLISH_FILLER) -> Column:
    """A question without filler, squeezed; as it was if fewer than two characters are left.

    Chinese filler goes wherever it stands, English filler as whole words in any case; one after the other in the given order.
    """
    left = query
    for filler in chinese:
        left = F.replace(left, F.lit(filler), F.lit(" "))
    for filler in english:
        left = F.regexp_replace(left, rf"(?i)\b{re.escape(filler)}\b", " ")
    left = squeezed(left)
    return F.when(F.length(left) >= 2, left).otherwise(query)


def wants_recent(query: Column, words: Iterable[str] = L.RECENCY_WORDS) -> Column:
    """Whether a question asks for what is new."""
    return F.coalesce(F.lower(query).rlike("|".join(map(re.escape, words))), F.lit(False))


def has_chinese(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


_TAXON = "struct<domain: string, field: string, subfield: string>"


def _taxon(domain, field, subfield) -> Column:
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (domain, field, subfield)]
    return F.struct(*[p.cast("string").alias(n) for p, n in zip(parts, ("domain", "field", "subfield"), strict=True)])


def _filled(values: Column) -> Column:
    """Squeezed values of an array that are not empty."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: squeezed(F.coalesce(v, F.lit("")))), lambda v: v != "")


def category_taxon(categories: Column) -> Column:
    """Domain, field and subfield by the first category: its own entry, else its archive's, else physics."""
    first = F.coalesce(F.get(categories, 0), F.lit(""))
    low = F.lower(first)
    out = F.when(F.lit(False), F.lit(None).cast(_TAXON))
    for code, taxa in L.CATEGORY_TAXA.items():
        out = out.when(low == code, _taxon(*taxa))
    for archive, taxa in L.ARCHIVE_TAXA.items():
        out = out.when(F.split_part(low, F.lit("."), F.lit(1)) == archive, _taxon(*taxa, first))
    return out.otherwise(_taxon(*L.OTHER_ARCHIVE, first))


def subject_taxon(subjects: Column, fallback: Column) -> Column:
    """Domain, field and subfield by the first rule that a word part of any subject fits; else by ``fallback`` as the only subject."""

    def ruled(values: Column) -> Column:
        text, first = F.lower(F.array_join(values, " ")), F.coalesce(F.get(_filled(values), 0), F.lit(""))
        out = F.when(F.lit(False), F.lit(None).cast(_TAXON))
        for parts, domain, field in L.SUBJECT_RULES:
            out = out.when(text.rlike("|".join(map(re.escape, parts))), _taxon(domain, field, first))
        return out

    return F.coalesce(ruled(subjects), ruled(_filled(F.array(fallback))), _taxon("Cross-field", "Unknown", ""))


def keyword_subfield(keywords: Column) -> Column:
    """The first normalised keyword of four or more characters that isn't generic; empty without one."""
    normal = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: bound(k, normal_keyword))
    return F.coalesce(F.get(F.filter(normal, lambda k: (F.length(k) >= 4) & ~k.isin(*L.GENERIC_SUBFIELDS)), 0), F.lit(""))


def taxonomy(source: Column, topic: Column, categories: Column, subjects: Column, raw_keywords: Column, seed: Column, field: Column, keywords: Column) -> Column:
    """A paper's place in the taxonomy, with where that comes from.

    The source picks one rule: a topic (``topic``: struct of ``name, domain, field, subfield``), preprint categories, journal
    subjects, biomedical keywords, or else the seed of the harvest. A rule that leaves domain or field open is completed by
    the seed, else the paper's field; an open subfield by the paper's keywords. Gives a struct of ``domain, field, subfield,
    taxonomy_source, taxonomy_confidence, raw_taxonomy_terms`` (at most twelve, joined by ``;``).
    """
    text = lambda c: squeezed(F.coalesce(c.cast("string"), F.lit("")))
    none = F.array().cast("array<string>")
    given = F.when(F.coalesce(seed, F.lit("")) != "", seed).otherwise(F.coalesce(field, F.lit("")))
    codes, heads = _filled(categories), _filled(subjects)
    mesh = F.when(F.size(F.coalesce(raw_keywords, none)) > 0, raw_keywords).otherwise(F.coalesce(keywords, none))
    mesh_terms = _filled(F.slice(mesh, 1, 8))
    topic_terms = F.filter(F.array(*[text(topic[k]) for k in ("name", "domain", "field", "subfield")]), lambda t: t != "")

    def rule(taxon: Column, name: str, sure: float, else_: float, terms: Column) -> Column:
        confidence = F.when(F.size(terms) > 0, F.lit(sure)).otherwise(F.lit(else_))
        return F.struct(taxon.alias("t"), F.lit(name).alias("name"), confidence.alias("confidence"), F.coalesce(terms, none).alias("terms"))

    def picked(by_seed: Column) -> Column:
        medical = F.when(by_seed["domain"] == "Cross-field", _taxon("Health Sciences", "Medicine", keyword_subfield(mesh)))
        medical = medical.otherwise(_taxon(by_seed["domain"], by_seed["field"], keyword_subfield(mesh)))
        return (
            F.when(source == "openalex", rule(_taxon(*[text(topic[k]) for k in ("domain", "field", "subfield")]), "openalex_primary_topic", 0.95, 0.55, topic_terms))
            .when(source == "arxiv", rule(category_taxon(codes), "arxiv_category", 0.9, 0.55, codes))
            .when(source == "doaj", rule(subject_taxon(heads, F.coalesce(seed, F.lit(""))), "doaj_subject", 0.82, 0.55, heads))
            .when(source.isin("pubmed", "pmc"), rule(medical, "biomedical_keywords", 0.75, 0.6, mesh_terms))
            .otherwise(rule(by_seed, "field_seed", 0.55, 0.55, F.filter(F.array(seed, field), lambda t: t.isNotNull() & (t != ""))))
        )

    def completed(by_seed: Column, pick: Column) -> Column:
        own = pick["t"]
        open_ = (own["domain"] == "") | (own["field"] == "")
        domain, name = F.when(open_, by_seed["domain"]).otherwise(own["domain"]), F.when(open_, by_seed["field"]).otherwise(own["field"])
        below = F.when(own["subfield"] != "", own["subfield"]).when(open_ & (by_seed["subfield"] != ""), by_seed["subfield"]).otherwise(keyword_subfield(keywords))
        return F.struct(
            domain.alias("domain"), name.alias("field"), below.alias("subfield"), pick["name"].alias("taxonomy_source"), pick["confidence"].alias("taxonomy_confidence"),
            F.array_join(F.slice(pick["terms"], 1, 12), ";").alias("raw_taxonomy_terms"),
        )

    return bound(subject_taxon(F.array(given), F.lit("")), lambda s: bound(picked(s), lambda p: completed(s, p)))
