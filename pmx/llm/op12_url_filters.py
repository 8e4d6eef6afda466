"""URL filter: rules for hosts and paths first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A rule names a host and the start of a path; it fits the host and all its subdomains, and the longest rule that fits
decides. Where none does, the terms of the vocabulary are sought in host and path, all in one walk of the automaton: a hit counts
if no letter stands next to it. A strict term weighs as much as the limit, a soft one less, each distinct term once; from
``LIMIT`` on the url is blocked, so one strict or several distinct soft terms do it.

Edge cases: a null url, or one without ``://``, has an empty host and an empty path, and is allowed; port and user stay in the host as
they stand in the url, so a rule does not fit such a host; escapes (``%20``) are read as the characters they stand for when terms are sought,
bytes that are no text as a replacement sign; the query and the fragment hold no terms; a very long url is walked once; repeated
rows stay; null ids pass through; an empty table gives an empty result; only ``page_id`` and ``url`` are read, so other columns change nothing.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Fixed values: (verdict, host, start of the path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The vocabulary, lower case. One strict term, or so many distinct soft ones, block a url.
STRICT = ["porn", "porno", "xxx", "hentai", "milf", "nsfw", "camgirl", "camgirls", "escorts", "viagra", "cialis", "levitra", "warez", "keygen", "malware", "phishing"]
SOFT = ["ads", "adult", "bet", "bets", "betting", "bonus", "cams", "casino", "cheap", "clickbait", "crack", "dating", "drugs", "farm", "free", "gambling", "hookup", "jackpot",
        "loans", "lottery", "naked", "nude", "payday", "pharmacy", "pills", "poker", "prize", "replica", "sex", "sexy", "slots", "spam", "torrent", "track", "tracker", "win", "x"]
LIMIT, WEIGHT_STRICT, WEIGHT_SOFT = 2, 2, 1
_PARTS = re.compile(r"([^/?#]*)([^?#]*)")
_LOWER = {c: c + 32 for c in range(65, 91)}


def vocabulary(strict: list[str] = STRICT, soft: list[str] = SOFT) -> dict[str, int]:
    """The weight of each term."""
    return {t: WEIGHT_SOFT for t in soft} | {t: WEIGHT_STRICT for t in strict}


def split_url(url: str | None) -> tuple[str, str]:
    """Host, in lower case, and path."""
    _, mark, rest = (url or "").partition("://")
    host, path = _PARTS.match(rest).groups() if mark else ("", "")
    return host.translate(_LOWER), path


class Rules:
    """Rules by host: of a host the ends as long as some rule's host are looked up, where a dot or nothing stands before them."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule in rules:
            self.by_host.setdefault(rule[1], []).append(rule)
        self.lengths = sorted({len(h) for h in self.by_host}, reverse=True)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, as (host and path, verdict); of equally long ones that with the longer host."""
        best = None
        for n in self.lengths:
            at = len(host) - n
            if at == 0 or at > 0 and host[at - 1] == ".":
                for verdict, h, p in self.by_host.get(host[at:], ()):
                    if path.startswith(p) and (best is None or len(h + p) > len(best[0])):
                        best = h + p, verdict
        return best


class Terms:
    """The terms of a weighted vocabulary in a text, where no letter touches them."""

    def __init__(self, weights: dict[str, int]):
        import ahocorasick

        self.weights, self.automaton = weights, ahocorasick.Automaton()
        for t in weights:
            self.automaton.add_word(t, t)
        if weights:
            self.automaton.make_automaton()

    def find(self, text: str) -> set[str]:
        if not self.weights:
            return set()
        return {t for end, t in self.automaton.iter(text) if not text[end + 1 : end + 2].isalpha() and not (end >= len(t) and text[end - len(t)].isalpha())}


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, weights: dict[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, terms (those found, sorted) and their weight, of every page.

    Rules and terms go along with the tasks: lists of some hundred thousand entries, made by hand or by a crawl's operator, not tables that grow with the pages.
    """
    weights = vocabulary() if weights is None else weights

    def rows(it):
        known, terms = Rules(rules), Terms(weights)
        for batch in it:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                hits = sorted(terms.find(unquote(host + path).translate(_LOWER)))
                weight = sum(weights[t] for t in hits)
                rule, verdict = known.find(host, path) or (None, "block" if weight >= limit else "allow")
                out.append((host, path, rule, verdict, hits, weight))
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64())
            cols = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["page_id", "host", "path", "rule", "verdict", "terms", "weight"])

    d = pages.select("page_id", "url")
    kind = d.schema["page_id"].dataType.simpleString()
    return d.mapInArrow(rows, f"page_id {kind}, host string, path string, rule string, verdict string, terms array<string>, weight long")


def kept_pages(pages: DataFrame, **how) -> DataFrame:
    """The pages whose url is allowed, with all their columns; urls are judged once each."""
    urls = pages.select("url").distinct()
    bad = url_verdicts(urls.selectExpr("url AS page_id", "url"), **how).filter("verdict = 'block'").selectExpr("page_id AS url")
    return pages.join(bad, "url", "left_anti").select(*pages.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages")).drop("terms")


NAME = "op12_url_filters"


def _oracle() -> str:
    fits = [f"SELECT '{h}{p}' AS rule, '{v}' AS rule_verdict, '{h}' AS h, '{p}' AS p" for v, h, p in RULES]
    weight = " +\n       ".join(rf"CASE WHEN regexp_matches(s, '(^|[^\p{{L}}]){t}($|[^\p{{L}}])') THEN {w} ELSE 0 END" for t, w in vocabulary().items())
    return rf"""
WITH rules AS ({" UNION ALL ".join(fits)}),
parts AS (
  SELECT row_number() OVER () AS n, page_id, translate(COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fitting AS (
  SELECT n, rule, rule_verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC, length(h) DESC) AS place
  FROM parts JOIN rules ON starts_with(path, p) AND (host = h OR ends_with(host, '.' || h))),
weighed AS (
  SELECT n, page_id, host, path, translate(url_decode(host || path), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM parts),
totals AS (SELECT n, page_id, host, path, {weight} AS weight FROM weighed)
SELECT page_id, host, path, rule, COALESCE(rule_verdict, CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, CAST(weight AS BIGINT) AS weight
FROM totals LEFT JOIN (SELECT * FROM fitting WHERE place = 1) f USING (n)"""


ORACLE = _oracle()
