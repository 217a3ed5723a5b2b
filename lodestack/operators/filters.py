"""Predicates over keywords, names, texts and ids, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import normal_keyword, normal_title


def is_keyword_signal(keyword: Column) -> Column:
    """At least 3 characters, not general, not a code, not digits alone, all in normal form."""
    k = normal_keyword(keyword)
    return (F.length(k) >= 3) & ~k.isin(*C.GENERIC_KEYWORDS) & ~k.rlike(r"^[a-z]{1,5}\.[a-z0-9.-]{1,12}$") & ~k.rlike("^[0-9]+$")


def _is_archive(label: Column) -> Column:
    """A preprint archive's name by itself, or followed by one word of up to three letters."""
    spaced = F.regexp_replace(label, r"\s+", " ")
    last = F.element_at(F.split(spaced, " "), -1)
    named = F.substr(spaced, F.lit(1), F.greatest(F.length(spaced) - F.length(last) - 1, F.lit(0)))
    return spaced.isin(*C.ARCHIVES) | (last.rlike("^[a-z]{1,3}$") & named.isin(*C.ARCHIVES))


def noise_reason(keyword: Column) -> Column:
    """Why a keyword can't be a topic, or null. Null counts as the empty keyword."""
    label = F.lower(F.trim(F.coalesce(keyword, F.lit(""))))
    venue = F.exists(F.array(*map(F.lit, C.VENUE_FRAGMENTS + C.VENUE_FRAGMENTS_EXTRA)), lambda part: F.contains(label, part))
    rules = {
        "letter": F.length(label) < 2,
        "discipline": label.isin(*C.GENERIC_LABELS) | label.rlike(C.DISCIPLINE_SUFFIX),
        "venue": label.isin(*C.VENUE_NAMES) | venue,
        "category": label.rlike(C.CATEGORY_CODE) | _is_archive(label),
        "joined": F.contains(label, F.lit(". ")),
    }
    return F.coalesce(*[F.when(rule, name) for name, rule in rules.items()])


def is_noise_keyword(keyword: Column) -> Column:
    return noise_reason(keyword).isNotNull()


def is_report_keyword(keyword: Column, stop: tuple[str, ...] = C.REPORT_STOP) -> Column:
    k = F.lower(F.trim(F.coalesce(keyword, F.lit(""))))
    return (F.length(k) >= 4) & ~is_noise_keyword(keyword) & ~k.isin(*stop)


def has_marker(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether a text, in lower case, holds one of some marks. Null holds none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))


def follow_up(question: Column, before: Column) -> Column:
    """A question that refers to what was said, with the question before it in front; any other as it is."""
    return F.when(before.isNotNull() & has_marker(question, C.REFERENCE_WORDS), F.concat_ws(" ", before, question)).otherwise(question)


def page_verdict(text: Column, rendered: Column, least: int = 80, least_rendered: int = 700) -> Column:
    """``blocked``, ``short`` or ``kept`` for a page's text; a page that a browser rendered must be longer."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.when(has_marker(text, C.BLOCKED_PAGE), "blocked").when(words < F.when(rendered, least_rendered).otherwise(least), "short").otherwise("kept")


def is_informative_author(name: Column) -> Column:
    """At least 5 characters, no digit, and more than a surname with one initial."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(n) >= 5) & ~n.rlike("[0-9]") & ~n.rlike(r"^\S+ [A-Z]\.?$")


def is_failed_pdf(text: Column) -> Column:
    """Raw PDF structure within the first 4000 characters."""
    return F.substring(F.coalesce(text, F.lit("")), 1, 4000).rlike(C.PDF_STRUCTURE)


def clean_full_text(text: Column, walls: tuple[str, ...] = ("enable javascript", "are you a robot")) -> Column:
    """The text, or the empty text where it is raw PDF, a script or a bot wall."""
    t = F.coalesce(text, F.lit(""))
    bad = is_failed_pdf(t) | F.lower(t).contains("<script")
    for wall in walls:
        bad = bad | F.lower(t).contains(wall)
    return F.when(bad, "").otherwise(t)


def is_front_matter(title: Column) -> Column:
    return normal_title(title).isin(*C.FRONT_MATTER)


def bad_id_reason(paper_id: Column) -> Column:
    """Why an id cannot be one, or null."""
    i = F.trim(F.coalesce(paper_id, F.lit("")))
    return (
        F.when(i == "", "blank").when(i.contains(" "), "space").when(F.length(i) > 80, "long")
        .when(F.lower(i).isin("unknown", "none", "null", "n/a", "id", "paper_id", "example", "placeholder", "todo"), "placeholder")
        .when(i.rlike("^0+1?$"), "placeholder")
    )


def budget_reason(text: Column, turn: Column, max_chars: int, max_turns: int) -> Column:
    """Why a turn is over budget, or null."""
    return F.when(F.length(text) > max_chars, "turn_too_long").when(turn > max_turns, "history_too_long")


def names_field(raw: Column, wanted: str | None, fields: tuple[str, ...] = C.FIELD_NAMES) -> Column:
    """Whether a raw JSON record names ``wanted`` under one of ``fields``, however deep below it; case is ignored.

    A blank ``wanted`` matches every record.
    """
    needle = (wanted or "").strip().lower()
    if not needle:
        return F.lit(True)
    parts = F.array(*[F.get_json_object(raw, f"$.{f}") for f in fields])
    # of what lies below a field only values count, not the names of inner fields
    values = F.regexp_replace(F.array_join(parts, " "), r'"[A-Za-z_]+"\s*:', " ")
    return F.contains(F.lower(F.regexp_replace(values, r'[\[\]{}",]+', " ")), F.lit(needle))
