"""Mapping raw records of eight sources to one paper shape, as column expressions over the raw JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import first_year, normal_doi, squeezed, without_markup
from .dedupe import best_per_key

TEXTS = "array<string>"


def text_at(raw: Column, *paths: str) -> Column:
    """The first of some JSON paths that holds a text that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(raw, p)), F.lit("")) for p in paths])


def list_at(raw: Column, path: str, field: str | None = None) -> Column:
    """A JSON array of texts, or of objects by one field; an empty array where there is none."""
    if field is None:
        out = F.from_json(F.get_json_object(raw, path), TEXTS)
    else:
        out = F.from_json(F.get_json_object(raw, path), f"array<struct<`{field}`:string>>").getField(field)
    return F.filter(F.coalesce(out, F.array().cast(TEXTS)), lambda x: F.trim(x) != "")


def either_list(raw: Column, path: str, field: str) -> Column:
    """Texts or objects, whichever the array holds."""
    objects = list_at(raw, path, field)
    return F.when(F.get_json_object(raw, f"{path}[0].{field}").isNotNull(), objects).otherwise(list_at(raw, path))


def restored_abstract(index: Column) -> Column:
    """Text of an inverted index (word to places); at a place with two words the later one stays."""
    places = F.from_json(index, "map<string,array<int>>")
    pairs = F.flatten(F.transform(F.map_entries(places), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.array_sort(pairs)
    last = F.filter(ordered, lambda x, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1)["p"] != x["p"]))
    return F.array_join(F.transform(last, lambda x: x["w"]), " ")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)


def _open_graph(r: Column) -> dict[str, Column]:
    concepts = F.from_json(F.get_json_object(r, "$.concepts"), "array<struct<display_name:string,score:double>>")
    strong = F.transform(F.filter(F.coalesce(concepts, F.array().cast("array<struct<display_name:string,score:double>>")), lambda c: c["score"] >= 0.3), lambda c: c["display_name"])
    topic = F.filter(F.array(text_at(r, "$.primary_topic.display_name")), lambda x: x.isNotNull())
    people = F.from_json(F.get_json_object(r, "$.authorships"), "array<struct<author:struct<display_name:string>>>")
    return {
        "paper_id": last_segment(text_at(r, "$.id")), "title": text_at(r, "$.display_name", "$.title"),
        "abstract": restored_abstract(F.get_json_object(r, "$.abstract_inverted_index")), "year": text_at(r, "$.publication_year"),
        "authors": F.filter(F.coalesce(F.transform(people, lambda p: p["author"]["display_name"]), F.array().cast(TEXTS)), lambda x: x.isNotNull()),
        "keywords": F.slice(F.array_distinct(F.concat(list_at(r, "$.keywords", "display_name"), strong, topic)), 1, 12),
        "field": text_at(r, "$.primary_topic.domain.display_name", "$.primary_topic.field.display_name"),
    }


def _preprint(r: Column) -> dict[str, Column]:
    return {
        "paper_id": F.regexp_replace(last_segment(text_at(r, "$.id")), "v[123]$", ""), "title": text_at(r, "$.title"), "abstract": text_at(r, "$.summary"),
        "year": text_at(r, "$.published", "$.updated"), "authors": either_list(r, "$.authors", "name"), "keywords": list_at(r, "$.categories"), "field": F.lit(None).cast("string"),
    }


def _simple(*ids: str) -> Callable[[Column], dict[str, Column]]:
    return lambda r: {
        "paper_id": text_at(r, *ids), "title": text_at(r, "$.title"), "abstract": text_at(r, "$.abstract", "$.body_excerpt"),
        "year": text_at(r, "$.year", "$.yearPublished", "$.publishedDate"), "authors": either_list(r, "$.authors", "name"),
        "keywords": F.concat(list_at(r, "$.keywords"), list_at(r, "$.topics")), "field": F.lit(None).cast("string"),
    }


def _registry(r: Column) -> dict[str, Column]:
    people = F.from_json(F.get_json_object(r, "$.author"), "array<struct<given:string,family:string>>")
    return {
        "paper_id": text_at(r, "$.DOI"), "title": text_at(r, "$.title[0]", "$.title"), "abstract": without_markup(text_at(r, "$.abstract")),
        "year": text_at(r, "$.published-print.date-parts[0][0]", "$.published-online.date-parts[0][0]", "$.issued.date-parts[0][0]"),
        "authors": F.coalesce(F.transform(people, lambda p: F.concat_ws(" ", p["given"], p["family"])), F.array().cast(TEXTS)),
        "keywords": list_at(r, "$.subject"), "field": F.lit(None).cast("string"),
    }


def _scholar(r: Column) -> dict[str, Column]:
    return {
        "paper_id": text_at(r, "$.paperId"), "title": text_at(r, "$.title"), "abstract": text_at(r, "$.abstract"), "year": text_at(r, "$.year"),
        "authors": list_at(r, "$.authors", "name"), "keywords": F.array_distinct(F.concat(list_at(r, "$.fieldsOfStudy"), list_at(r, "$.s2FieldsOfStudy", "category"))),
        "field": F.lit(None).cast("string"),
    }


def _directory(r: Column) -> dict[str, Column]:
    return {
        "paper_id": text_at(r, "$.id"), "title": text_at(r, "$.bibjson.title"), "abstract": text_at(r, "$.bibjson.abstract"), "year": text_at(r, "$.bibjson.year"),
        "authors": list_at(r, "$.bibjson.author", "name"), "keywords": F.concat(list_at(r, "$.bibjson.keywords"), list_at(r, "$.bibjson.subject", "term")),
        "field": F.lit(None).cast("string"),
    }


#: Mapping of each source.
SOURCES: dict[str, Callable[[Column], dict[str, Column]]] = {
    "openalex": _open_graph, "arxiv": _preprint, "pubmed": _simple("$.pmid", "$.id"), "pmc": _simple("$.pmcid", "$.id"), "crossref": _registry,
    "semantic_scholar": _scholar, "doaj": _directory, "core": _simple("$.id"),
}


def normal_papers(wrappers: DataFrame, *keep: str) -> DataFrame:
    """``source, source_id, paper_id, title, abstract, authors, year, keywords, field, doi, invalid`` of wrapper rows.

    Rows of unknown sources, and rows without id and title, are invalid. Keywords are lower-cased with
    hyphens as spaces; a field that is not given comes from the wrapper's seed, else ``unknown``. Columns to ``keep`` come along.
    """
    raw = F.col("raw")
    names = ["paper_id", "title", "abstract", "year", "authors", "keywords", "field"]
    picked = {n: F.lit(None).cast(TEXTS if n in ("authors", "keywords") else "string") for n in names}
    for source, mapping in SOURCES.items():
        shaped = mapping(raw)
        picked = {n: F.when(F.col("source") == source, shaped[n]).otherwise(picked[n]) for n in names}
    seed = F.nullif(F.lower(F.trim("field_seed")), F.lit(""))
    empty = F.array().cast(TEXTS)
    rows = wrappers.select(
        "source", "source_id", picked["paper_id"].alias("paper_id"), without_markup(picked["title"]).alias("title"),
        squeezed(without_markup(F.coalesce(picked["abstract"], F.lit("")))).alias("abstract"), F.coalesce(picked["authors"], empty).alias("authors"),
        first_year(picked["year"]).alias("year"), F.transform(F.coalesce(picked["keywords"], empty), lambda k: F.replace(F.lower(F.trim(k)), F.lit("-"), F.lit(" "))).alias("keywords"),
        F.coalesce(F.lower(picked["field"]), seed, F.lit("unknown")).alias("field"), normal_doi(text_at(raw, "$.doi", "$.DOI")).alias("doi"), *keep,
    )
    known = F.col("source").isin(*SOURCES)
    return rows.withColumn("invalid", ~F.coalesce(known, F.lit(False)) | (F.col("paper_id").isNull() & F.col("title").isNull()))


def with_provenance(papers: DataFrame, ceiling: int) -> DataFrame:
    """Adds ``original_year, year_status, partition_year, text_for_analysis``; years past ``ceiling`` become null."""
    late = F.col("year") > ceiling
    return papers.select(
        *[c for c in papers.columns if c != "year"], F.when(~late, F.col("year")).alias("year"), F.col("year").alias("original_year"),
        F.when(late, "future_year_suspect").otherwise("ok").alias("year_status"),
        F.when(late, "future_year_suspect").otherwise(F.coalesce(F.col("year").cast("string"), F.lit("unknown"))).alias("partition_year"),
        F.concat_ws(" ", "title", "title", "abstract").alias("text_for_analysis"),
    )


_PLACE = "struct<id:string,display_name:string,country_code:string>"
_AUTHORSHIP = (
    "array<struct<author:struct<id:string,display_name:string,orcid:string>,raw_author_name:string,raw_orcid:string,author_position:string,"
    f"is_corresponding:boolean,institutions:array<{_PLACE}>,affiliations:array<struct<institution_ids:array<string>>>,countries:array<string>,raw_affiliation_strings:array<string>>>"
)


def _told(*lists: Column) -> Column:
    """Texts of all lists in order, trimmed, each once, without blanks."""
    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast(TEXTS)) for x in lists]))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != ""))


def authorships(raw: Column) -> Column:
    """A record's authors in order, with ids, places and countries; those without a name are left out."""
    first = lambda *c: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in c], F.lit(""))

    def entry(a: Column, i: Column) -> Column:
        under = F.flatten(F.transform(F.coalesce(a["affiliations"], F.array().cast("array<struct<institution_ids:array<string>>>")), lambda x: F.coalesce(x["institution_ids"], F.array().cast(TEXTS))))
        return F.struct(
            first(a["author"]["id"]).alias("author_id"), first(a["author"]["display_name"], a["raw_author_name"]).alias("display_name"),
            first(a["raw_author_name"]).alias("raw_author_name"), first(a["author"]["orcid"], a["raw_orcid"]).alias("orcid"),
            first(a["author_position"], (i + 1).cast("string")).alias("author_position"), (i + 1).alias("author_position_index"),
            F.coalesce(a["is_corresponding"], F.lit(False)).alias("is_corresponding"), _told(a["institutions"]["id"], under).alias("institution_ids"),
            _told(a["institutions"]["display_name"]).alias("institutions"), _told(a["countries"], a["institutions"]["country_code"]).alias("country_codes"),
            _told(a["raw_affiliation_strings"]).alias("raw_affiliation_strings"),
        )

    listed = F.from_json(F.get_json_object(raw, "$.authorships"), _AUTHORSHIP)
    return F.coalesce(F.filter(F.transform(listed, entry), lambda a: a["display_name"] != ""), F.array())


def author_entries(structured: Column, names: Column) -> Column:
    """A paper's authors in order with key and where it comes from: of its ``authorships``, else of its plain ``names``.

    The key is the author's id, else the ORCID, else the normalised name; authors without a name or a key are left out.
    Names stand in only where there are no structured authorships at all.
    """
    key_of = lambda name: F.nullif(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), F.lit(""))
    named = lambda name: F.concat(F.lit("name:"), key_of(name))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    none = F.array().cast(TEXTS)

    def entry(key, author, author_id, raw, orcid, position, role, corresponding, lists, source):
        texts = {"author_key": key, "author": author, "author_id": author_id, "raw_author_name": raw, "orcid": orcid}
        columns = [F.coalesce(c, F.lit("")).alias(n) for n, c in texts.items()]
        columns += [position.cast("int").alias("author_position"), F.coalesce(role, F.lit("")).alias("author_role"), corresponding.alias("is_corresponding")]
        columns += [F.coalesce(c, none).alias(n) for n, c in zip(("institution_ids", "institutions", "country_codes", "raw_affiliation_strings"), lists, strict=True)]
        return F.struct(*columns, source.alias("identity_source"))

    def of_structure(a: Column) -> Column:
        author_id, orcid, name = filled(a["author_id"]), filled(a["orcid"]), filled(a["display_name"])
        source = F.when(author_id.isNotNull(), "author_id").when(orcid.isNotNull(), "orcid").otherwise("name")
        lists = [a[n] for n in ("institution_ids", "institutions", "country_codes", "raw_affiliation_strings")]
        raw = F.coalesce(filled(a["raw_author_name"]), name)
        return entry(F.coalesce(author_id, orcid, named(name)), name, author_id, raw, orcid, a["author_position_index"], a["author_position"], a["is_corresponding"], lists, source)

    def of_name(name: Column, i: Column) -> Column:
        plain = filled(name)
        return entry(named(plain), plain, F.lit(""), plain, F.lit(""), i + 1, F.lit(""), F.lit(False), [none] * 4, F.lit("name"))

    known = lambda entries: F.filter(entries, lambda e: (e["author"] != "") & (e["author_key"] != ""))
    fallback = known(F.transform(F.coalesce(names, none), of_name))
    return F.when(F.size(F.coalesce(structured, F.array())) > 0, known(F.transform(structured, of_structure))).otherwise(fallback)


#: A summary record of the open-access archive, as its service gives it.
SUMMARY = "struct<uid: string, title: string, pubdate: string, fulljournalname: string, articleids: array<struct<idtype: string, value: string>>, authors: array<struct<name: string>>>"


def summary_records(record: Column) -> Column:
    """A summary record (``SUMMARY``) as a wrapper's ``source_id`` and ``raw`` payload, a JSON text.

    Of several identifiers of one type the last counts. The record's id is its archive number, else its uid, always with
    the archive's prefix; the year is the first 19xx or 20xx of its date.
    """
    ids = F.coalesce(record["articleids"], F.array())
    last = lambda kind: F.get(F.reverse(F.transform(F.filter(ids, lambda i: F.lower(i["idtype"]) == kind), lambda i: F.trim(F.coalesce(i["value"], F.lit(""))))), 0)
    blank = lambda c: F.coalesce(c, F.lit(""))
    given = F.coalesce(F.nullif(last("pmc"), F.lit("")), F.nullif(last("pmcid"), F.lit("")), F.concat(F.lit("PMC"), blank(record["uid"])))
    number = F.when(given.startswith("PMC"), given).otherwise(F.concat(F.lit("PMC"), given))
    raw = F.to_json(F.struct(
        number.alias("pmcid"), blank(record["title"]).alias("title"), F.lit("").alias("abstract"),
        F.transform(F.coalesce(record["authors"], F.array()), lambda a: F.trim(blank(a["name"]))).alias("authors"),
        F.regexp_extract(blank(record["pubdate"]), "((?:19|20)[0-9]{2})", 1).alias("year"), F.array(blank(record["fulljournalname"])).alias("keywords"),
        blank(record["fulljournalname"]).alias("journal"), blank(last("doi")).alias("doi"), F.lit("").alias("body_excerpt"),
    ))
    return F.struct(number.alias("source_id"), raw.alias("raw"))


def normalize_job(wrappers: DataFrame, path: str, order: str = "line_order") -> dict[str, int]:
    """Write the normalised papers of ``wrappers`` to ``path``, one of each id (of each title and year where there is none): the
    first by file and ``order``. Gives how many records came in, went out, were duplicates or invalid.

    The counts are observed in the pass that writes, so they cost no second scan.
    """
    came, went = Observation("came"), Observation("went")
    papers = normal_papers(wrappers, "raw_file", order).observe(came, F.count("*").alias("input"), F.count_if("invalid").alias("invalid"))
    key = F.coalesce(F.nullif("paper_id", F.lit("")), F.concat(F.coalesce("title", F.lit("")), F.lit("::"), F.coalesce(F.col("year").cast("string"), F.lit(""))))
    kept = best_per_key(papers.where("not invalid"), [key], [], F.struct("raw_file", order)).drop("raw_file", order, "invalid")
    kept.observe(went, F.count("*").alias("output")).write.mode("overwrite").parquet(path)
    counts = came.get | went.get
    return {"input": counts["input"], "output": counts["output"], "duplicates": counts["input"] - counts["invalid"] - counts["output"], "invalid": counts["invalid"]}
