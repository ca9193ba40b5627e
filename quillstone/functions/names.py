"""Keywords, tags, limits and instants: the scalar rules that callers see.

A keyword is stored without its colon.  Its name is what follows the first slash (all of it where there is none)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

from .errors import BadRequest, Refused

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def canonical(text: str | None) -> str | None:
    """A type as given: one leading colon goes, blank becomes None."""
    if not isinstance(text, str) or not text.strip():
        return None
    return text[1:] if text.startswith(":") else text


def canonical_col(c: Column) -> Column:
    return F.regexp_replace(c, "^:", "")


def name_col(c: Column) -> Column:
    """Name of a keyword column: without the first segment."""
    return F.regexp_replace(c, "^[^/]+/", "")


def namespace_col(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "^([^/]+)/.+", 1), F.lit(""))


def tag_names(given: Iterable[str]) -> list[str]:
    """Names of tags while keywords (":a/b") and plain strings ("a/b") can still be told apart."""
    return [re.sub("^[^/]+/", "", t[1:]) if t.startswith(":") else t for t in given]


def rendered(c: Column) -> Column:
    """A keyword as it shows in session types."""
    return F.concat(F.lit(":"), c)


def parse_tags(param: str | None) -> list[str]:
    """Comma-separated tags; blank ones drop out, others aren't trimmed."""
    return [t for t in (param or "").split(",") if t.strip()]


def limit(value: int | str | None, default: int = 100, most: int = 5000, layered: bool = True) -> int:
    """A limit between 1 and ``most``, or a refusal."""
    if value is None:
        return default
    try:
        n = int(str(value))
    except ValueError:
        n = 0
    if not 1 <= n <= most:
        raise Refused(4, "invalid-limit", limit=value, maximum=most) if layered else BadRequest("invalid-limit", limit=value, maximum=most)
    return n


def memory_limit(value: int | None) -> int:
    """Clamped: 20 where none or not positive, at most 100."""
    return 20 if value is None or value <= 0 else min(value, 100)


def instant(value) -> datetime | None:
    """Epoch milliseconds (number or digits), a datetime, or strict ISO-8601; anything else raises."""
    if value is None:
        return None
    if isinstance(value, datetime):
        return value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    if isinstance(value, (int, float)) or re.fullmatch(r"-?\d+", str(value)):
        return datetime.fromtimestamp(int(value) / 1000, timezone.utc)
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:\d\d)", str(value)):
        raise ValueError(f"not an instant: {value!r}")
    text = re.sub(r"(\.\d{6})\d+", r"\1", str(value)).replace("Z", "+00:00")
    return datetime.fromisoformat(text)


def any_equals(c: Column, values: list) -> Column:
    return c == values[0] if len(values) == 1 else c.isin(values)


def stable_hyperedge_id(type_: Column, endpoints: Column) -> Column:
    return F.concat(F.lit("hx:"), type_, F.lit(":"), F.array_join(F.array_sort(endpoints), "."))


def stable_relation_id(src: Column, type_: Column, dst: Column, note: Column | None = None, order: Column | None = None) -> Column:
    blank = F.lit("")
    parts = [src, type_, dst, blank if note is None else note.cast("string"), blank if order is None else order.cast("string")]
    return F.concat_ws("|", F.lit("rel"), *[F.coalesce(p, blank) for p in parts])
