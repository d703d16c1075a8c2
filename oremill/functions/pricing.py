"""Offer prices in free text: an Arrow UDF, since each period marker may serve one amount only."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocabulary import FREE, MARKER_REACH, MONEY, MONTH, MOST_MONTHLY, NOT_AN_OFFER, PERCENT, YEAR

_I = re.IGNORECASE
PRICE = "array<struct<amount_monthly:double,raw:string>>"


def offers(text: str | None) -> list[dict]:
    """Monthly amounts of a price string.  Amounts are read from left to right; each takes the nearest free marker that no
    other amount separates from it, a year's before a month's at equal distance."""
    line = re.sub(PERCENT, " ", text or "")
    if re.search(NOT_AN_OFFER, line, _I):
        return []
    amounts = list(re.finditer(MONEY, line))
    free = sorted([(*m.span(), 1) for m in re.finditer(MONTH, line, _I)] + [(*m.span(), 12) for m in re.finditer(YEAR, line, _I)])
    fences = [0, *(m.end() for m in amounts[:-1])], [*(m.start() for m in amounts[1:]), len(line)]
    found = []
    for m, left, right in zip(amounts, *fences):
        value = float(m[1].replace(",", ""))
        if value:
            gaps = [(m.start() - e if e <= m.start() else s - m.end(), -months, (s, e, months)) for s, e, months in free if (left <= s and e <= m.start()) or (m.end() <= s and e <= right)]
            near = min((g for g in gaps if g[0] <= MARKER_REACH), default=None)
            if near is None:
                continue
            free.remove(near[2])
            value = round(value / 12, 2) if near[1] == -12 else value
            if value > MOST_MONTHLY:
                continue
        found.append({"amount_monthly": value, "raw": m[0].strip()})
    if re.search(FREE, line, _I) and all(float(m[1].replace(",", "")) for m in amounts):
        found.append({"amount_monthly": 0.0, "raw": "free"})
    return found


def _offers(texts: pd.Series) -> pd.Series:
    return texts.map(offers)


def parse_prices(text) -> Column:
    """All offers of a column of price strings."""
    return F.pandas_udf(_offers, PRICE)(text)


def priced_amounts(claims: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, amount, rows): the monthly amounts of price strings; each distinct string of a key is parsed once."""
    strings = claims.groupBy(*keys, text).agg(F.count("*").alias("rows"))
    each = strings.select(*keys, "rows", F.explode(parse_prices(text)).alias("p"))
    return each.groupBy(*keys, F.col("p.amount_monthly").alias("amount")).agg(F.sum("rows").alias("rows"))


def price_band(amounts: DataFrame, keys: list[str]) -> DataFrame:
    """Exact quartiles of the paid amounts (amount, rows) by `keys`, and the number of free tiers; no row's band is null without paid ones.

    Amounts are whole cents up to a bound, so the counted amounts of a key are few whatever its rows.
    """
    paid = F.col("amount") > 0
    q = F.percentile(F.when(paid, F.col("amount")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.when(paid, F.col("rows")).otherwise(1))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("rows"))), F.lit(0))
    return amounts.groupBy(*keys).agg(n(paid).alias("n"), n(F.col("amount") == 0).alias("free_tier_count"), q.alias("q")).select(
        *keys, "n", "free_tier_count", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median_monthly"), F.col("q")[2].alias("p75")
    )
