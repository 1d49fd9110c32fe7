"""JSON: lenient parsing of model output, object edits, and the evidence format."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"^\s*```[A-Za-z0-9_-]*\s*\n?(.*?)\n?\s*```\s*$", re.S)
_TIGHT = (",", ":")
_CONTROL = {chr(code): "\\" + letter for code, letter in ((10, "n"), (13, "r"), (9, "t"))}


def escape_controls(text: str) -> str:
    """Raw control characters inside strings become escapes; everything else stays."""
    out, inside, escaped = [], False, False
    for c in text:
        if inside and c < " ":
            out.append(_CONTROL.get(c, f"\\u{ord(c):04x}"))
            escaped = False
            continue
        if c == '"' and not escaped:
            inside = not inside
        escaped = inside and c == "\\" and not escaped
        out.append(c)
    return "".join(out)


def lenient(text: str | None, allow_array: bool = False) -> str | None:
    """Canonical JSON of a model's answer: without a code fence, with raw control characters
    escaped; null unless it is an object (or an array, where allowed)."""
    if text is None:
        return None
    fence = _FENCE.match(text)
    body = fence.group(1) if fence else text.strip()
    for attempt in (body, escape_controls(body)):
        try:
            value = json.loads(attempt)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict) or (allow_array and isinstance(value, list)):
            return json.dumps(value, separators=_TIGHT, ensure_ascii=False)
        return None
    return None


@F.pandas_udf(StringType())
def lenient_udf(text: pd.Series) -> pd.Series:
    return text.map(lenient, na_action="ignore")


def schema_echo(text: Column) -> Column:
    """Whether an answer repeats the schema instead of filling it in."""
    has = lambda k: F.get_json_object(text, f"$.{k}").isNotNull()
    return F.coalesce(has("properties") & (has("type") | has("$defs") | has("required")), F.lit(False))


def compact(value: Column) -> Column:
    """Evidence JSON: compact, non-ASCII kept, null fields kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def without_keys(text: Column, *keys: str) -> Column:
    """A flat JSON object of strings without some keys."""
    held = F.map_filter(F.from_json(text, "map<string,string>"), lambda k, _: ~k.isin(*keys))
    return F.to_json(held)


def has_key(text: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(F.from_json(text, "map<string,string>"), key), F.lit(False))


def flag(text: Column, key: str) -> Column:
    """A boolean field, false where it is missing or no boolean."""
    return F.coalesce(F.get_json_object(text, f"$.{key}").try_cast("boolean"), F.lit(False))
