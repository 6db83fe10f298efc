"""Payloads of any shape to rows: values found in JSON, and unlock events and distributions from JSON, HTML, CSV and text.

JSON objects become maps of texts in the order of their keys, so that all rules over them are columns. Walking a document
of unknown depth, and reading tables, are small functions over Arrow batches; the order of keys matters there, which the
variant type does not keep.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text

MAP, MAPS = "map<string,string>", "array<map<string,string>>"
# Names of fields, in the order of trial where there is one.
SCHEDULES = ("release_schedule", "releaseschedule", "unlocks", "releasecalendar")
DISTRIBUTIONS = ("distribution", "allocations", "allocation")
METRICS = {
    "price_usd": ("price", "priceusd", "current_price"),
    "circulating_supply": ("circulating_supply", "circulatingsupply", "circulating"),
    "total_supply": ("total_supply", "totalsupply", "max_supply"),
    "market_cap": ("market_cap", "marketcap"),
    "volume": ("volume", "total_volume", "volume24h"),
}
ROW_DATES = ("unlock_date", "date", "unlockDate", "startDate", "eventDate")
ROW_LABELS = ("allocationName", "standardAllocationName", "label", "name", "bucket")
ROW_TOKENS = ("unlockAmount", "tokens_to_unlock", "tokens", "amount", "value")
ROW_PERCENTS = ("percentage", "percent")
SHARE_LABELS = ("label", "name", "allocationName", "standardAllocationName", "bucket")
SHARE_VALUES = ("share", "percentage", "percent", "tokens", "amount")
DATED = ("date", "event_date", "unlockdate", "unlock_date")
DATE_HEADERS = ("date", "unlock date", "release date", "vesting date", "event date")
LABEL_HEADERS = ("label", "bucket", "allocation", "category", "group", "recipient", "allocation name")
TOKEN_HEADERS = ("tokens", "amount", "token amount", "unlock amount", "qty", "quantity")
PERCENT_HEADERS = ("pct", "percentage", "percent", "%", "share")
HINTS = ("total_supply", "max_supply", "fully diluted supply", "fully_diluted_supply")
TEXT_ROW = r"(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}).{0,40}?([A-Za-z][A-Za-z /_-]{2,80}).{0,20}?(\d[\d,\.]*)"


# ---- JSON of any shape


def _loads(s: str | None) -> Any:
    try:
        return json.loads(s) if s else None
    except (ValueError, RecursionError):
        return None


def find_first(payload: Any, keys: set[str]) -> Any:
    """The value of the first of ``keys`` that an object has, before its children are looked at; objects come depth first.

    An object whose first such key is null holds nothing, nor do its children.
    """
    todo = [payload]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            hit = [v for k, v in x.items() if k.lower() in keys][:1]
            if hit and hit[0] is not None:
                return hit[0]
            if not hit:
                todo += reversed(x.values())
        elif isinstance(x, list):
            todo += reversed(x)
    return None


def collect_lists(payload: Any, keys: set[str]) -> list[list]:
    """All lists under one of ``keys``, an outer one before those in it."""
    todo, found = [("", payload)], []
    while todo:
        key, x = todo.pop()
        if key in keys and isinstance(x, list):
            found.append(x)
        if isinstance(x, dict):
            todo += [(k.lower(), v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            todo += [("", v) for v in reversed(x)]
    return found


def objects_with(payload: Any, keys: set[str]) -> list[dict]:
    """All objects that have one of ``keys``, an outer one before those in it."""
    todo, found = [payload], []
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if any(k.lower() in keys for k in x):
                found.append(x)
            todo += reversed(x.values())
        elif isinstance(x, list):
            todo += reversed(x)
    return found


def _text(x: Any) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def json_find_first(s: Column, keys: tuple[str, ...]) -> Column:
    """The first value under one of ``keys`` (lower case): its text, or its JSON if it is none; null if there is none."""
    wanted = set(keys)

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([_text(find_first(_loads(x.as_py()), wanted)) for x in batch], pa.string())

    return run(s)


def json_collect_lists(s: Column, keys: tuple[str, ...]) -> Column:
    """The JSON of all lists under one of ``keys`` (lower case)."""
    wanted = set(keys)

    @F.arrow_udf("array<string>")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([[_text(v) for v in collect_lists(_loads(x.as_py()), wanted)] for x in batch], pa.list_(pa.string()))

    return run(s)


def canonical_json(s: Column) -> Column:
    """JSON with sorted keys, without spaces, in ASCII; null for what isn't JSON."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        parsed = [_loads(x.as_py()) for x in batch]
        return pa.array([None if v is None else json.dumps(v, sort_keys=True, separators=(",", ":")) for v in parsed], pa.string())

    return run(s)


# ---- rows of a schedule or distribution


def _first(row: Column, names: tuple[str, ...]) -> Column:
    """The first field that holds something: not missing, empty, null, false or zero."""
    held = lambda v: F.when(~v.isin("", "false", "null") & ~(v.try_cast("double").eqNullSafe(0.0)), v)
    return F.coalesce(*[held(F.try_element_at(row, F.lit(n))) for n in names])


def _rows(payload: Column) -> Column:
    """A list's objects, or the one object, as maps of texts."""
    return F.coalesce(F.when(F.ltrim(payload).startswith("["), F.from_json(payload, MAPS)).when(F.ltrim(payload).startswith("{"), F.array(F.from_json(payload, MAP))), F.array().cast(MAPS))


def _number(s: Column) -> Column:
    return text.safe_float(s)


def _share_of(percent: Column, supply: Column) -> Column:
    """Tokens from a percentage (over 1) or fraction of a supply above 0."""
    return F.when(supply > 0, F.when(percent > 1, percent / 100).otherwise(percent) * supply)


def _event(day: Column, label: Column, tokens: Column) -> Column:
    return F.struct(day.alias("event_date"), label.alias("raw_label"), text.bucket(label).alias("bucket"), tokens.alias("tokens"))


def _whole(events: Column) -> Column:
    return F.filter(events, lambda e: e["event_date"].isNotNull() & e["raw_label"].isNotNull() & (e["tokens"] >= 0))


def schedule_events(payload: Column, supply: Column) -> Column:
    """Events (event_date, raw_label, bucket, tokens) of a schedule: an array or object of rows in one of three shapes.

    A row has a date and a list of ``allocations``; or a date and an object of labels and tokens; or is an event itself.
    Tokens may come as a percentage of ``supply``. Events without date, label or tokens of 0 or more are left out.
    """

    def from_row(row: Column, day: Column | None = None) -> Column:
        own = text.parse_date(_first(row, ROW_DATES))
        percent = _number(F.replace(_first(row, ROW_PERCENTS), F.lit("%"), F.lit("")))
        return _event(own if day is None else F.coalesce(day, own), _first(row, ROW_LABELS), F.coalesce(_number(_first(row, ROW_TOKENS)), _share_of(percent, supply)))

    def events(row: Column) -> Column:
        listed, named = F.try_element_at(row, F.lit("allocations")), F.try_element_at(row, F.lit("allocation_details"))
        day = text.parse_date(_first(row, ("date", "unlockDate", "startDate", "eventDate")))
        named_day = text.parse_date(_first(row, ROW_DATES))
        pairs = F.map_entries(F.from_json(named, MAP))
        return (
            F.when(F.startswith(listed, F.lit("[")), F.transform(F.from_json(listed, MAPS), lambda a: from_row(a, day)))
            .when(F.startswith(named, F.lit("{")), F.transform(pairs, lambda p: _event(named_day, p["key"], _number(p["value"]))))
            .otherwise(F.array(from_row(row)))
        )

    return _whole(F.flatten(F.transform(_rows(payload), events)))


def _fraction(value: Column) -> Column:
    return F.when((value > 1) & (value <= 100), value / 100).otherwise(value)


def distribution_items(payload: Column) -> Column:
    """Items (raw_label, bucket, value) of a distribution; values over 1 and up to 100 are percentages."""

    def item(row: Column) -> Column:
        label, value = _first(row, SHARE_LABELS), _number(_first(row, SHARE_VALUES))
        return F.struct(label.alias("raw_label"), text.bucket(label).alias("bucket"), _fraction(value).alias("value"))

    return F.filter(F.transform(_rows(payload), item), lambda x: x["raw_label"].isNotNull() & x["value"].isNotNull())


# ---- documents with header rows


def _tables(content: str, kind: str) -> Iterator[tuple[list[str], list[list[str]]]]:
    """Header and rows of every table."""
    if kind == "csv":
        rows = [r for r in csv.reader(io.StringIO(content)) if r]
        if rows:
            yield rows[0], [(r + [""] * len(rows[0]))[: len(rows[0])] for r in rows[1:]]
    elif kind == "html":
        tables: dict[int, list[list[str]]] = {}
        for t, _, row in text.html_tables(content):
            if any(row):
                tables.setdefault(t, []).append(row)
        for rows in tables.values():
            yield rows[0], [r for r in rows[1:] if len(r) == len(rows[0])]


def _named(content: str | None, kind: str) -> list[list[tuple[str, str]]]:
    """Rows of a document as (name, value) in order; of two columns with one name the last counts."""
    if kind == "json":
        found = objects_with(_loads(content), set(DATED))
        return [[(k.strip().lower(), _text(v)) for k, v in row.items()] for row in found]
    return [list({h.strip().lower(): v for h, v in zip(header, row)}.items()) for header, rows in _tables(content or "", kind) for row in rows]


def document_kind(mime: Column, url: Column) -> Column:
    """json, csv, pdf, html or text, by the type, else by how the address ends."""
    m, u = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    kind = F.when(m.contains("json") | u.endswith(".json"), "json").when(m.contains("csv") | u.endswith(".csv"), "csv").when(m.contains("pdf") | u.endswith(".pdf"), "pdf")
    return kind.when(m.contains("html") | u.endswith(".html") | u.endswith(".htm"), "html").otherwise("text")


def document_rows(content: Column, kind: Column) -> Column:
    """Rows of a document as arrays of (name, value): of JSON objects that have a date, of tables by their own header, of dated text.

    Pages may be read by nothing here, and give no rows, as a PDF does.
    """

    @F.arrow_udf("array<array<struct<name:string,value:string>>>")
    def read(contents: pa.Array, kinds: pa.Array) -> pa.Array:
        rows = [[[{"name": n, "value": v} for n, v in row] for row in _named(c.as_py(), k.as_py())] for c, k in zip(contents, kinds)]
        return pa.array(rows, pa.list_(pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))))

    part = lambda k: F.regexp_extract_all(content, F.lit(TEXT_ROW), F.lit(k))
    field = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    from_text = F.transform(F.arrays_zip(part(1).alias("d"), part(2).alias("l"), part(3).alias("t")), lambda r: F.array(field("date", r["d"]), field("label", r["l"]), field("tokens", F.replace(r["t"], F.lit(","), F.lit("")))))
    return F.when(kind == "text", from_text).otherwise(read(content, kind))


def _last(row: Column, fits) -> Column:
    """The value of the last field whose name fits."""
    return F.try_element_at(F.filter(row, lambda f: fits(f["name"])), F.lit(-1))["value"]


def _is_date(n: Column) -> Column:
    return n.isin(*DATE_HEADERS) | n.contains("date")


def _is_label(n: Column) -> Column:
    return n.isin(*LABEL_HEADERS) | n.rlike("allocation|bucket|category")


def _is_tokens(n: Column) -> Column:
    return n.isin(*TOKEN_HEADERS) | n.rlike("token|amount")


def _plain(s: Column) -> Column:
    return _number(F.replace(F.replace(s, F.lit("%"), F.lit("")), F.lit(","), F.lit("")))


def supply_hint(rows: Column) -> Column:
    """The largest supply above 0 that any row names."""
    found = F.transform(F.flatten(rows), lambda f: F.when(f["name"].isin(*HINTS), _number(f["value"])))
    return F.array_max(F.filter(found, lambda v: v > 0))


def row_events(rows: Column) -> Column:
    """Events of document rows: columns are known by their names; tokens may be a percentage of the supply in the row."""

    def event(row: Column) -> Column:
        label = _last(row, lambda n: ~_is_date(n) & _is_label(n))
        tokens = _number(F.replace(_last(row, lambda n: ~_is_date(n) & ~_is_label(n) & _is_tokens(n)), F.lit(","), F.lit("")))
        percent = _plain(_last(row, lambda n: ~_is_date(n) & ~_is_label(n) & ~_is_tokens(n) & n.isin(*PERCENT_HEADERS)))
        supply = F.coalesce(*[_number(_last(row, lambda n, h=h: n == h)) for h in HINTS[:3]])
        return _event(text.parse_date(F.trim(_last(row, _is_date))), label, F.coalesce(tokens, _share_of(percent, supply)))

    return _whole(F.transform(rows, event))


def row_distribution(rows: Column) -> Column:
    """Distribution items (raw_label, bucket, value) of document rows."""

    def item(row: Column) -> Column:
        label = _last(row, _is_label)
        value = _plain(_last(row, lambda n: ~_is_label(n) & (n.isin(*PERCENT_HEADERS) | n.rlike("token|amount|share"))))
        return F.struct(label.alias("raw_label"), text.bucket(label).alias("bucket"), _fraction(value).alias("value"))

    return F.filter(F.transform(rows, item), lambda x: x["raw_label"].isNotNull() & x["value"].isNotNull())
