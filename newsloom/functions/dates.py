"""Publication dates: parsers with their time-zone rules, and dates of which parts are unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KYIV = "Europe/Kyiv"
MONTHS = {m: k + 1 for k, m in enumerate("січня лютого березня квітня травня червня липня серпня вересня жовтня листопада грудня".split())}
_ZONE = r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$"
RANKS = {name: k for k, name in enumerate("unknown year month day".split())}


def iso_utc(text: Column, naive_zone: str = KYIV) -> Column:
    """UTC instant (without zone) of ISO 8601 text; times without an offset are in naive_zone."""
    clean = F.replace(F.trim(text), F.lit("T"), F.lit(" "))
    shaped = clean.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?: [0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]+)?)?)?" + _ZONE.removesuffix("$") + "?$")
    stamp = F.try_to_timestamp(F.when(shaped, clean))
    return F.when(clean.rlike(_ZONE), stamp.cast("timestamp_ntz")).otherwise(F.to_utc_timestamp(stamp.cast("timestamp_ntz"), naive_zone).cast("timestamp_ntz"))


def rfc2822_utc(text: Column) -> Column:
    """UTC instant of mail dates such as `Tue, 02 Jun 2026 09:35:00 +0300`."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\s+(?:GMT|UTC|Z)$", " +0000")
    shaped = plain.rlike(r"^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}$")
    return F.try_to_timestamp(F.when(shaped, plain), F.lit("d MMM yyyy HH:mm:ss xx")).cast("timestamp_ntz")


def ukrainian_utc(text: Column) -> Column:
    """UTC instant of textual dates such as `15 квітня 2021 р. 13:55`, in Kyiv time; midnight without a time."""
    shape = r"(?iu)([0-9]{1,2})\s+(" + "|".join(MONTHS) + r")\s+([0-9]{4})(?:[^0-9]{0,12}([0-9]{1,2}):([0-9]{2}))?"
    part = lambda k: F.regexp_extract(F.lower(text), shape, k)
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.try_element_at(table, part(2))
    local = F.try_make_timestamp_ntz(number(part(3)), month, number(part(1)), number(part(4)), number(part(5)), F.lit(0).cast("decimal(8,6)"))
    return F.to_utc_timestamp(local, KYIV).cast("timestamp_ntz")


def first_parseable(candidates: list[Column]) -> Column:
    """The first candidate that some parser understands; each is tried as ISO, mail and textual date."""
    return F.coalesce(*[p(c) for c in candidates for p in (iso_utc, rfc2822_utc, ukrainian_utc)])


def in_window(moment: Column, since: Column | None = None, until: Column | None = None) -> Column:
    """Within the closed window; unknown moments pass."""
    ok = F.lit(True)
    if since is not None:
        ok = ok & (moment >= since)
    if until is not None:
        ok = ok & (moment <= until)
    return moment.isNull() | ok


def partial(text: Column, precision: Column) -> Column:
    """struct<year, month, day, precision> of `YYYY[-MM[-DD]]` text, as far as the precision goes."""
    parts = F.split(text, "-")
    part = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("int")
    return F.struct(
        F.when(precision.isin("year", "month", "day"), part(1)).alias("year"), F.when(precision.isin("month", "day"), part(2)).alias("month"),
        F.when(precision == "day", part(3)).alias("day"), precision.alias("precision"),
    )


def infer_precision(text: Column) -> Column:
    """Precision by the shape of the text; unknown for anything else."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "day").when(text.rlike("^[0-9]{4}-[0-9]{2}$"), "month").when(text.rlike("^[0-9]{4}$"), "year").otherwise("unknown")


def conflicts(a: Column, b: Column) -> Column:
    """Whether a part known on both sides differs; unknown parts are compatible with any."""
    test = F.lit(False)
    for part in ("year", "month", "day"):
        test = test | F.coalesce(a[part] != b[part], F.lit(False))
    return test


def enrich(a: Column, b: Column) -> Column:
    """a with its unknown parts from b, at the finer precision of both."""
    rank = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    finer = F.when(rank[b["precision"]] > rank[a["precision"]], b["precision"]).otherwise(a["precision"])
    return F.struct(*[F.coalesce(a[p], b[p]).alias(p) for p in ("year", "month", "day")], finer.alias("precision"))


def partial_text(value: Column) -> Column:
    """`YYYY[-MM[-DD]]` of a partial date; null without a year."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    month = F.when(value["month"].isNotNull(), F.concat(F.lit("-"), two(value["month"]), F.when(value["day"].isNotNull(), F.concat(F.lit("-"), two(value["day"]))).otherwise(""))).otherwise("")
    return F.when(value["year"].isNotNull(), F.concat(F.lpad(value["year"].cast("string"), 4, "0"), month))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header (a number or a mail date), 1 at least; null for neither."""
    number = F.floor(header.try_cast("double"))
    until = F.timestamp_diff("SECOND", now, rfc2822_utc(header))
    return F.greatest(F.lit(1), F.coalesce(number, until)).cast("long") * F.when(F.coalesce(number, until).isNotNull(), 1)
