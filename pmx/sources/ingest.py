"""Ingestion as Spark data sources.

Paged services (by cursor or offset) and block ranges of a chain are read by partitions; a provider
makes the calls. Option ``provider`` names it as ``module:function`` (importable by the executors); live ones need a
network and are not part of this package. The default is offline: it makes rows from their number, so that plans and tests run
anywhere. A schema given to the reader replaces the source's own, for services with other columns.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

C = F.col
TRADES = "trade_id string, ticker string, count int, yes_price int, no_price int, taker_side string, created_time string"
LOGS = "block_number long, log_index int, maker string, taker string, maker_asset_id string, taker_asset_id string, maker_amount long, taker_amount long"


MARKETS = "ticker string, event_ticker string, status string, result string, volume long"
#: Answers of a service after which a call is made again.
RETRY_STATUS = {429, 500, 502, 503, 504}


class HttpStatus(Exception):
    """A provider's answer with a status that is no success."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


class RangeTooLarge(Exception):
    """A provider's answer to a range with too many rows."""


def with_retry(call: Callable, attempts: int = 5, first: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result; waits twice as long after each failed connection or busy answer, and gives up after ``attempts``.

    Other answers (a wrong request, a missing page) are raised at once.
    """
    for i in range(attempts):
        try:
            return call()
        except (ConnectionError, TimeoutError, HttpStatus) as e:
            if i == attempts - 1 or isinstance(e, HttpStatus) and e.status not in RETRY_STATUS:
                raise
            sleep(min(most, first * 2**i))


def provider(options, default: Callable) -> Callable:
    """The function that option ``provider`` names, or the default."""
    name = options.get("provider")
    if not name:
        return default
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"provider {name} is not module:function")
    return getattr(import_module(module), function)


def read_range(fetch: Callable[[int, int], list], start: int, end: int) -> Iterator:
    """Rows of [start, end): ranges that are too large are halved."""
    todo = [(start, end)]
    while todo:
        a, b = todo.pop()
        try:
            yield from with_retry(lambda: fetch(a, b))  # noqa: B023
        except RangeTooLarge:
            if b - a <= 1:
                raise
            m = (a + b) // 2
            todo += [(m, b), (a, m)]


def read_pages(fetch: Callable[[str | None], tuple[list, str | None]], cursor: str | None = None) -> Iterator:
    """Rows of all pages, following the cursor."""
    while True:
        rows, cursor = with_retry(lambda: fetch(cursor))  # noqa: B023
        yield from rows
        if not cursor:
            return


@dataclass
class Span(InputPartition):
    start: int
    end: int


def offline_logs(start: int, end: int, most: int = 400) -> list[tuple]:
    """Made-up fills: two a block; more than ``most`` rows in one call are refused."""
    if 2 * (end - start) > most:
        raise RangeTooLarge
    return [(b, i, f"0x{b % 7}", f"0x{b % 11}", "0" if (b + i) % 2 else str(b % 5 + 1), str(b % 5 + 1) if (b + i) % 2 else "0", 10 * (b % 9 + 1), 20 * (b % 4 + 1)) for b in range(start, end) for i in range(2)]


class ChainLogs(DataSource):
    """format("pmx_chain_logs"): options start, end, step (blocks a partition), provider: (start, end) -> rows."""

    @classmethod
    def name(cls) -> str:
        return "pmx_chain_logs"

    def schema(self) -> str:
        return LOGS

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)


class _LogReader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.start, self.end, self.step = (int(options.get(k, v)) for k, v in (("start", 0), ("end", 1000), ("step", 1000)))

    def partitions(self):
        return [Span(a, min(a + self.step, self.end)) for a in range(self.start, self.end, self.step)]

    def read(self, partition):
        yield from read_range(provider(self.options, offline_logs), partition.start, partition.end)


def offline_trades(ticker: int) -> Callable[[str | None], tuple[list, str | None]]:
    """Pages of 20 made-up trades of a market."""

    def fetch(cursor: str | None):
        at = int(cursor or 0)
        rows = [(f"{ticker}-{i}", f"KXT-{ticker}", i % 7 + 1, (ticker * 13 + i * 7) % 99 + 1, 99 - (ticker * 13 + i * 7) % 99, "yes" if i % 3 else "no", f"2024-01-{i % 28 + 1:02d}T10:00:00.{i}Z") for i in range(at, min(at + 20, 10 + ticker % 40))]
        nxt = at + 20
        return rows, str(nxt) if nxt < 10 + ticker % 40 else None

    return fetch


class MarketTrades(DataSource):
    """format("pmx_market_trades"): options markets, per_partition, provider: market -> (cursor -> rows, next cursor)."""

    @classmethod
    def name(cls) -> str:
        return "pmx_market_trades"

    def schema(self) -> str:
        return TRADES

    def reader(self, schema) -> DataSourceReader:
        return _TradeReader(self.options)


class _TradeReader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.markets, self.step = int(options.get("markets", 100)), int(options.get("per_partition", 25))

    def partitions(self):
        return [Span(a, min(a + self.step, self.markets)) for a in range(0, self.markets, self.step)]

    def read(self, partition):
        trades_of = provider(self.options, offline_trades)
        for t in range(partition.start, partition.end):
            yield from read_pages(trades_of(t))


def offline_markets(cursor: str | None) -> tuple[list[tuple], str | None]:
    """Pages of 50 made-up markets, 120 in all; the cursor is an offset, as some services have it."""
    at = int(cursor or 0)
    rows = [(f"KXT-{i}", f"KXE-{i % 9}", "finalized" if i % 4 else "open", ("yes" if i % 3 else "no") if i % 4 else "", 10 * i) for i in range(at, min(at + 50, 120))]
    return rows, str(at + 50) if at + 50 < 120 else None


class MarketList(DataSource):
    """format("pmx_markets"): option provider: cursor -> (rows, next cursor); option cursor resumes. A chain of cursors is one partition."""

    @classmethod
    def name(cls) -> str:
        return "pmx_markets"

    def schema(self) -> str:
        return MARKETS

    def reader(self, schema) -> DataSourceReader:
        return _MarketReader(self.options)


class _MarketReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        yield from read_pages(provider(self.options, offline_markets), self.options.get("cursor"))


def register_sources(spark: SparkSession) -> None:
    for source in (ChainLogs, MarketTrades, MarketList):
        spark.dataSource.register(source)


def parse_timestamp(text):
    """ISO text with a Z or an offset and any number of decimals, as a timestamp; null if it is none."""
    whole = F.regexp_replace(text, "Z$", "+00:00")
    return F.try_to_timestamp(F.regexp_replace(whole, r"(\.\d{6})\d+", "$1"))


def collateral(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file address -> {collateral_address, collateral_symbol} as rows, addresses in lower case."""
    one = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<collateral_address:string, collateral_symbol:string>>")).alias("a", "c"))
    return one.select(F.lower("a").alias("fpmm_address"), "c.collateral_address", "c.collateral_symbol")


def interpolate_blocks(samples: DataFrame) -> DataFrame:
    """(block_number, ts) of all blocks between samples (ts in whole seconds), by straight lines rounded down.

    The next sample comes from a window over ranges of a thousand blocks and one row of each following range, so no task holds
    all samples.
    """
    from pyspark.sql import Window as W

    s = samples.select("block_number", "ts").distinct().withColumn("_r", F.floor(C("block_number") / 1000))
    firsts = s.groupBy("_r").agg(F.min(F.struct("block_number", "ts")).alias("_f"))
    after = firsts.withColumn("_n", F.lead("_f").over(W.partitionBy(F.lit(0)).orderBy("_r"))).select("_r", "_n")
    w = W.partitionBy("_r").orderBy("block_number")
    n = s.join(after, "_r").withColumn("_next", F.coalesce(F.lead(F.struct("block_number", "ts")).over(w), "_n"))
    b0, b1, t0, t1 = C("block_number"), C("_next.block_number"), C("ts"), C("_next.ts")
    between = n.withColumn("b", F.explode(F.when(b1.isNull(), F.array(b0)).otherwise(F.sequence(b0, b1 - 1))))
    at = F.when(b1.isNull(), t0).otherwise(t0 + F.floor((C("b") - b0) * (t1 - t0) / (b1 - b0)))
    return between.select(C("b").alias("block_number"), at.cast("long").alias("ts"))
