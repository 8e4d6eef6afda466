"""Outcome tokens and pools: what each resolved to, and the two positions of each of their trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pmx.operators.dealing import dealt

C = F.col


def token_resolution(markets: DataFrame, mode: str = "strict") -> DataFrame:
    """token_id, market_id, resolved, won from JSON arrays of ids and prices.

    strict: closed markets of two prices, one over .99 and the other under .01; the others give no row.
    lenient: any closed market; with a readable price a token is resolved, and won over .99.
    nary: closed markets whose highest price is .99 or more and whose lowest .01 or less.
    """
    ids = F.from_json("clob_token_ids", "array<string>")
    prices = F.transform(F.from_json("outcome_prices", "array<string>"), lambda p: p.try_cast("double"))
    m = markets.filter("closed").select(C("id").alias("market_id"), ids.alias("ids"), prices.alias("prices"))
    top, low = F.array_max("prices"), F.array_min("prices")
    if mode == "strict":
        m = m.filter((F.size("ids") == 2) & (F.size("prices") == 2) & (top > 0.99) & (low < 0.01))
    elif mode == "nary":
        m = m.filter((top >= 0.99) & (low <= 0.01))
    m = m.select("market_id", "prices", F.posexplode("ids").alias("i", "token_id"))
    price = F.get("prices", C("i"))
    return m.select("token_id", "market_id", price.isNotNull().alias("resolved"), F.when(price.isNotNull(), price > 0.99).alias("won"))


def pool_resolution(markets: DataFrame, collateral: DataFrame, symbol: str = "USDC") -> DataFrame:
    """fpmm_address (lower case), winning_outcome of closed markets with two prices, one over .99 and the other under .01.

    Only pools that ``collateral`` (fpmm_address, collateral_symbol) lists under ``symbol``; of several markets of one pool the last id counts.
    """
    p = F.transform(F.from_json("outcome_prices", "array<string>"), lambda x: x.try_cast("double"))
    winner = F.when((F.get("p", F.lit(0)) > 0.99) & (F.get("p", F.lit(1)) < 0.01), 0).when((F.get("p", F.lit(0)) < 0.01) & (F.get("p", F.lit(1)) > 0.99), 1)
    m = markets.filter("closed").select("id", F.lower("market_maker_address").alias("fpmm_address"), p.alias("p")).filter(F.size("p") == 2)
    m = m.select("id", "fpmm_address", winner.alias("winning_outcome")).filter("winning_outcome IS NOT NULL AND fpmm_address IS NOT NULL")
    listed = collateral.filter(C("collateral_symbol") == symbol).select(F.lower("fpmm_address").alias("fpmm_address"))
    return m.join(listed, "fpmm_address", "left_semi").groupBy("fpmm_address").agg(F.max_by("winning_outcome", "id").alias("winning_outcome"))


def _both_sides(rows: DataFrame) -> DataFrame:
    """price (whole cents) and won of buyer and seller, from rows (cents, won)."""
    cents = lambda x: F.round(x).cast("int").alias("price")
    both = F.array(F.struct(cents(C("cents")), C("won").alias("won")), F.struct(cents(F.lit(100.0) - C("cents")), (~C("won")).alias("won")))
    return rows.select(F.inline(both))


def token_positions(trades: DataFrame, tokens: DataFrame, rows: int = 0) -> DataFrame:
    """price, won of both sides of fills of resolved tokens; '0' is the cash asset. ``rows``: about how many trades there are, for how they are dealt."""
    buys = C("maker_asset_id") == "0"
    cash, amount = F.when(buys, C("maker_amount")).otherwise(C("taker_amount")), F.when(buys, C("taker_amount")).otherwise(C("maker_amount"))
    t = trades.filter("taker_amount > 0 AND maker_amount > 0").select(F.when(buys, C("taker_asset_id")).otherwise(C("maker_asset_id")).alias("token_id"), (F.lit(100.0) * (cash / amount)).alias("cents"))
    return _both_sides(dealt(t, rows, "token_id").join(tokens.select("token_id", "won"), "token_id"))


def pool_positions(trades: DataFrame, pools: DataFrame, rows: int = 0) -> DataFrame:
    """price, won of both sides of pool trades; amounts are whole numbers as text. ``rows``: how many trades there are at most."""
    paid, got = C("amount").try_cast("double"), C("outcome_tokens").try_cast("double")
    t = trades.filter(got > 0).select(F.lower("fpmm_address").alias("fpmm_address"), "outcome_index", (F.lit(100.0) * paid / got).alias("cents"))
    return _both_sides(dealt(t, rows, "fpmm_address").join(pools, "fpmm_address").select("cents", (C("outcome_index") == C("winning_outcome")).alias("won")))
