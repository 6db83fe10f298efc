"""Scalar functions over labels, dates, JSON and payload text."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that name a bucket as they are, then the parts of a label that do, in the order of trial.
ALIASES = {
    "Team/Founders": (
        "team", "founder", "founders", "founder / team", "founders / team", "core contributors", "contributors", "contributor sale", "advisors", "advisor", "employee", "employees",
    ),
    "VC/Investors": ("private investors", "public investors", "investor", "investors", "backers", "seed", "seed sale", "private sale", "strategic sale", "strategic"),
    "Airdrop/Public": ("public sale", "ido", "ieo", "ico", "launchpool", "launchpad", "community", "airdrop", "testnet incentive", "liquidity mining"),
    "Ecosystem": ("treasury", "foundation", "ecosystem", "rewards", "reward", "reserve", "reserved", "grants", "grant", "incentives"),
}
PARTS = (
    ("Team/Founders", ("team", "founder", "advisor", "contributor", "employee")),
    ("VC/Investors", ("investor", "backer", "private", "seed", "strategic", "series", "ico", "ieo", "launchpad", "launchpool")),
    ("Ecosystem", ("foundation", "treasury", "ecosystem", "reserve", "grant", "incentive")),
    ("Airdrop/Public", ("airdrop", "community", "public", "testnet", "reward", "liquidity mining")),
)
# Symbols left out of any universe, and the parts of symbols and names of stablecoins.
EXCLUDED_SYMBOLS = ("BTC", "ETH", "USDT", "USDC", "BUSD", "TUSD", "DAI", "FDUSD", "PYUSD", "USDD", "FRAX", "GUSD", "USDP", "WBTC", "WETH", "STETH", "CBETH", "RETH")
STABLE_SYMBOLS, STABLE_NAMES = ("USD", "EUR", "GBP", "JPY"), ("STABLECOIN", "PEGGED", "BRIDGED")
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd")


def bucket(label: Column) -> Column:
    """The bucket of a label: by its whole name, else by the first rule with a part of it; investors' parts of a public sale are public."""
    clean = F.trim(F.regexp_replace(F.lower(label), r"[_\-\s]+", " "))
    tries = [F.when(clean.isin(*names), name) for name, names in ALIASES.items()]
    for name, parts in PARTS:
        hit = F.when(clean.contains("public"), "Airdrop/Public").otherwise(name) if name == "VC/Investors" else F.lit(name)
        tries.append(F.when(clean.rlike("|".join(parts)), hit))
    return F.coalesce(*tries, F.lit("Other"))


def is_stablecoin(symbol: Column, name: Column) -> Column:
    return F.upper(symbol).isin(*EXCLUDED_SYMBOLS) | F.upper(symbol).rlike("|".join(STABLE_SYMBOLS)) | F.upper(name).rlike("|".join(STABLE_NAMES))


def parse_date(s: Column) -> Column:
    """Epoch seconds or milliseconds up to the year 9999, or one of four forms, tried in order."""
    number = s.try_cast("double")
    epoch = F.when(number > 1e12, number / 1000).when(number < 253402300800, number)
    tries = [F.when(s.rlike(r"^\d{9,13}$"), F.to_date(F.timestamp_seconds(epoch)))]
    tries += [F.try_to_timestamp(F.substr(s, F.lit(1), F.lit(10)), F.lit(f)).cast("date") for f in DATE_FORMATS]
    return F.coalesce(*tries)


def safe_float(s: Column) -> Column:
    x = F.when(~F.lower(F.trim(s)).isin("", "-", "nan", "none", "null"), s).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


class _Cells(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def table_rows(html: Column) -> Column:
    """(table_no, row_no, cells) of every table row of a page, read in Arrow batches."""

    @F.arrow_udf("array<struct<table_no:int,row_no:int,cells:array<string>>>")
    def rows(pages: pa.Array) -> pa.Array:
        found = [[dict(zip(("table_no", "row_no", "cells"), r)) for r in html_tables(x.as_py())] for x in pages]
        return pa.array(found, pa.list_(pa.struct([("table_no", pa.int32()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string()))])))

    return rows(html)


def html_tables(html: str | None) -> list[tuple[int, int, list[str]]]:
    """(table, row, cells) of every table row."""
    parser = _Cells()
    parser.feed(html or "")
    return [(t, r, row) for t, rows in enumerate(parser.tables) for r, row in enumerate(rows)]
