"""URL filtering by host and path rules and a weighted vocabulary.

A url's verdict is that of the longest rule that fits it. Where none does, the
vocabulary decides: one Aho-Corasick pass over the lower-cased url finds strict and
soft terms, a hit counting only between characters that are not ASCII letters or
digits. One strict term, or ``SOFT_LIMIT`` distinct soft ones, block the url.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh
from .words import as_utf8

# The vocabulary.
STRICT = ["casino", "cialis", "escort", "hentai", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx"]
SOFT = ["adult", "bet", "betting", "bonus", "cash", "cheap", "crack", "dating", "farm", "free", "hack", "keygen", "loan", "loans", "lottery", "pills", "poker", "prize", "replica", "sexy", "torrent", "win"]
SOFT_LIMIT = 2


class Rule(NamedTuple):
    action: str  # allow or block
    host: str
    path: str


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host = rest[:end].encode().lower().decode()
    path = rest[end:]
    stop = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return host, path[:stop]


class Judge:
    """Rules by host, and the vocabulary's automaton."""

    def __init__(self, rules: Iterable[Rule], strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT, soft_limit: int = SOFT_LIMIT):
        self.rules: dict[str, list[Rule]] = {}
        for r in rules:
            self.rules.setdefault(r.host, []).append(r)
        self.soft_limit = soft_limit
        self.terms = ahocorasick.Automaton()
        for word in soft:
            self.terms.add_word(word, (word, False))
        for word in strict:
            self.terms.add_word(word, (word, True))
        self.terms.make_automaton()

    def rule(self, host: str, path: str) -> Rule | None:
        """The longest fitting rule; of equally long ones the first given."""
        best, at = None, host
        while at:
            for r in self.rules.get(at, ()):
                if path.startswith(r.path) and (best is None or len(r.host + r.path) > len(best.host + best.path)):
                    best = r
            at = at.partition(".")[2]
        return best

    def hits(self, url: str | None) -> tuple[int, int]:
        """Distinct strict and distinct soft terms of a url."""
        low = (url or "").encode().lower().decode()
        found = set()
        for end, (word, is_strict) in self.terms.iter(low):
            a, b = end - len(word), end + 1
            if not (a >= 0 and low[a].isascii() and low[a].isalnum()) and not (b < len(low) and low[b].isascii() and low[b].isalnum()):
                found.add((word, is_strict))
        strict = sum(s for _, s in found)
        return strict, len(found) - strict

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = parts(url)
        rule = self.rule(host, path)
        strict, soft = self.hits(url)
        verdict = rule.action if rule else "block" if strict or soft >= self.soft_limit else "allow"
        return host, path, rule and rule.host + rule.path, verdict, strict, soft


def judge_urls(pages: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url", **vocabulary) -> DataFrame:
    """(id, host, path, rule, verdict, strict, soft) for every row of ``pages``.

    rule is the fitting rule's host and path, null where none fits; strict and soft
    count the vocabulary's distinct terms. Null urls and urls without ``://`` have an
    empty host and path and fit no rule; a null url holds no terms and is allowed.
    Rows with a null or repeated id are judged like any other; an empty table gives no
    rows; other columns are ignored.
    """
    fresh(pages, id_col, url_col)
    bounded_batches(pages.sparkSession)
    rules = list(rules)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules, **vocabulary)
        for batch in batches:
            rows = [judge.judge(u) for u in as_utf8(batch.column(1)).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "host", "path", "rule", "verdict", "strict", "soft"])

    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, strict int, soft int")
    return out.withColumnRenamed("id", id_col)


def oracle_sql(rules: Iterable[Rule], id_col: str = "page_id", table: str = "pages") -> str:
    """The same judgement in DuckDB SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = lambda x: f"translate({x}, '{upper}', '{upper.lower()}')"
    fits = " UNION ALL ".join(f"SELECT '{r.action}' AS action, '{r.host}' AS rhost, '{r.path}' AS rpath" for r in rules)
    count = lambda terms: " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT" for t in terms)
    return f"""
WITH rules AS ({fits}),
p AS (SELECT {id_col}, row_number() OVER () AS n, {low("coalesce(url, '')")} AS u,
        {low("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM {table}),
best AS (SELECT n, arg_max(action, length(rhost || rpath)) AS action, arg_max(rhost || rpath, length(rhost || rpath)) AS rule
        FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n),
h AS (SELECT *, {count(STRICT)} AS strict, {count(SOFT)} AS soft FROM p)
SELECT h.{id_col}, host, path, rule,
  coalesce(action, CASE WHEN strict > 0 OR soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  strict::INT AS strict, soft::INT AS soft
FROM h LEFT JOIN best USING (n)"""
