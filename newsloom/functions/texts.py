"""Text budgets, classifier and retrieval texts, markers, plurals and enum aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECULATIVE = ("можливо", "ймовірно", "потенційно", "може вплинути", "might", "could become", "potentially")
ENTITY_TYPES = ("person", "organization", "government", "company", "location", "media", "court", "other")
TYPE_ALIASES = {"people": "person", "org": "organization", "organisation": "organization", "ngo": "organization", "state_body": "government", "business": "company", "place": "location", "city": "location"}
CONTAMINATION = ("читайте також", "підписуйтесь", "реклама", "cookie", "javascript")


def budget(text: Column, limit: int) -> Column:
    """struct<text, chars, kept, truncated>: the first `limit` characters and the counts."""
    value = F.coalesce(text, F.lit(""))
    return F.struct(F.substring(value, 1, limit).alias("text"), F.length(value).alias("chars"), F.least(F.length(value), F.lit(limit)).alias("kept"), (F.length(value) > limit).alias("truncated"))


def prompt_chars(*parts: Column) -> Column:
    total = F.lit(0)
    for p in parts:
        total = total + F.coalesce(F.length(p), F.lit(0))
    return total


def classifier_text(title: Column, text: Column) -> Column:
    """Title, an empty line and the text, all trimmed; the text alone without a title."""
    t, x = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", x).otherwise(F.trim(F.concat(t, F.lit("\n\n"), x)))


def retrieval_text(*parts: Column) -> Column:
    """Trimmed, non-empty parts on lines of their own."""
    trimmed = F.transform(F.array(*parts), lambda p: F.trim(F.coalesce(p, F.lit(""))))
    return F.array_join(F.filter(trimmed, lambda p: p != ""), "\n")


def prefixed(kind: str, text: Column) -> Column:
    """`query: ` or `passage: ` before the text; an empty text is an error."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    return F.when(clean == "", F.raise_error(F.lit("empty text can't be embedded"))).otherwise(F.concat(F.lit(f"{kind}: "), clean))


def has_marker(text: Column, markers: tuple[str, ...] = SPECULATIVE) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))


def contaminated(text: Column) -> Column:
    """At least three of five marks of page furniture."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(m)).cast("int") for m in CONTAMINATION), F.lit(0)) >= 3


def quality_flags(title: Column, text: Column, least: int = 400) -> Column:
    """Names of what is wrong with an extraction."""
    blank = F.trim(F.coalesce(title, F.lit(""))) == ""
    short = F.length(F.coalesce(text, F.lit(""))) < least
    return F.array_compact(F.array(F.when(blank, "title_missing"), F.when(short, "text_short"), F.when(contaminated(text), "contaminated")))


def clamp(text: Column, limit: int) -> Column:
    """At most `limit` characters, without trailing punctuation where something was cut."""
    cut = F.regexp_replace(F.substring(text, 1, limit), r"[\s,.;:!?-]+$", "")
    return F.when(F.length(text) > limit, cut).otherwise(text)


def entity_type(raw: Column) -> Column:
    """The canonical entity type: known ones stay, aliases are mapped, the rest is `other`."""
    key = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    table = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.when(key.isin(*ENTITY_TYPES), key).otherwise(F.coalesce(F.try_element_at(table, key), F.lit("other")))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Ukrainian plural form of a count."""
    tens, units = F.pmod(F.abs(n), F.lit(100)), F.pmod(F.abs(n), F.lit(10))
    return F.when((units == 1) & (tens != 11), one).when(units.between(2, 4) & ~tens.between(12, 14), few).otherwise(many)


def page_window(page: int, pages: int) -> list[int | None]:
    """Page numbers to show, None for a gap: the ends, the page and its neighbours."""
    shown = sorted({p for p in (1, page - 1, page, page + 1, pages) if 1 <= p <= pages})
    out: list[int | None] = []
    for p in shown:
        if out and out[-1] is not None and p - out[-1] > 1:
            out.append(None if p - out[-1] > 2 else p - 1)
        out.append(p)
    return out


def slug(prefix: str, id_: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.replace(id_, F.lit("-"), F.lit("")))


def safe_slug(text: Column) -> Column:
    return F.coalesce((text.rlike("^[a-z0-9-]+$") & ~text.rlike("^-|--|-$")), F.lit(False))
