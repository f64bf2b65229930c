"""URL filters: host and path rules first, a weighted vocabulary for all other addresses.

The vocabulary has strict terms, of which one hit rejects, and soft terms, of which several
*distinct* hits reject. One Aho-Corasick automaton finds all terms in a single walk over the
address; a hit counts only between boundaries (neither neighbour is an ASCII letter or digit).

Defined results: a null address, or one without ``://``, has an empty host and path; a null
address has no hits and is allowed. Addresses are judged row by row, so repeated rows, ties and
extra columns change nothing and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_fold = str.maketrans(UPPER, LOWER)

STRICT_TERMS = (
    "casino", "escort", "hentai", "jackpot", "malware", "phishing", "porn", "spam-farm", "torrentz", "warez", "xxx",
)
SOFT_TERMS = (
    "adult", "bet", "bonus", "cheap", "clickbait", "coupon", "crack", "dating", "deal", "free", "keygen", "loan",
    "lottery", "nude", "pills", "poker", "ref", "spam", "utm_source", "win",
)


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT_TERMS
    soft: tuple[str, ...] = SOFT_TERMS
    #: Distinct soft terms that reject an address.
    soft_needed: int = 3


@dataclass(frozen=True)
class Rules:
    """``(verdict, "host/path")`` pairs; a rule fits its host and all its subdomains."""

    pairs: tuple[tuple[str, str], ...] = ()
    by_host: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        for verdict, rule in self.pairs:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((rule, "/" + path, verdict))

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        while host and self.by_host:
            for rule, start, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and (best is None or (len(rule), rule) > (len(best[0]), best[0])):
                    best = rule, verdict
            host = host.partition(".")[2]
        return best


class Matcher:
    def __init__(self, vocabulary: Vocabulary):
        self.needed = vocabulary.soft_needed
        self.find = ahocorasick.Automaton()
        for kind, terms in (("soft", vocabulary.soft), ("strict", vocabulary.strict)):
            for term in terms:
                self.find.add_word(term.translate(_fold), (kind, term))
        self.find.make_automaton()

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        text = url.translate(_fold)
        found: dict[str, set[str]] = {"strict": set(), "soft": set()}
        edge = lambda i: not (0 <= i < len(text) and text[i] in "abcdefghijklmnopqrstuvwxyz0123456789")
        for end, (kind, term) in self.find.iter(text):
            if edge(end + 1) and edge(end - len(term)):
                found[kind].add(term)
        return found["strict"], found["soft"]


def judge_urls(
    pages: DataFrame, rules: Rules, vocabulary: Vocabulary = Vocabulary(), id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, strict_hits, soft_hits."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.col(url_col).cast("string")
    rows = pages.select(
        F.col(id_col).alias("id"),
        url.alias("url"),
        F.translate(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")), UPPER, LOWER).alias("host"),
        F.coalesce(F.regexp_extract(url, pattern, 2), F.lit("")).alias("path"),
    )

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(vocabulary)
        for batch in batches:
            rule, verdict, strict, soft = [], [], [], []
            for url, host, path in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                a, b = matcher.hits(url or "")
                best = rules.longest(host, path)
                rule.append(best and best[0])
                verdict.append(best[1] if best else "block" if a or len(b) >= matcher.needed else "allow")
                strict.append(len(a))
                soft.append(len(b))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(rule, pa.string()), pa.array(verdict, pa.string()),
                 pa.array(strict, pa.int32()), pa.array(soft, pa.int32())],
                ["id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")
    return out.withColumnRenamed("id", id_col)


RULES = Rules((
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
))


def op10_url_filter(spark, sf_dir):
    from .common import table

    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def _term_sql(term: str) -> str:
    safe = term.replace("-", "[-]")
    return f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){safe}([^a-z0-9]|$)') THEN 1 ELSE 0 END"


def _oracle() -> str:
    v = Vocabulary()
    fits = []
    for verdict, rule in sorted(RULES.pairs, key=lambda p: (-len(p[1]), p[1])):
        host, _, path = rule.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", rule, verdict))
    case = lambda k: "CASE " + " ".join(f"WHEN {c} THEN '{(r, d)[k]}'" for c, r, d in fits)
    return rf"""
WITH p AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
h AS (SELECT *, CAST({' + '.join(map(_term_sql, v.strict))} AS INTEGER) AS strict_hits,
    CAST({' + '.join(map(_term_sql, v.soft))} AS INTEGER) AS soft_hits FROM p)
SELECT page_id, host, path, {case(0)} END AS rule,
    {case(1)} WHEN strict_hits > 0 OR soft_hits >= {v.soft_needed} THEN 'block' ELSE 'allow' END AS verdict,
    strict_hits, soft_hits FROM h"""


QUERIES = {"op10_url_filter": op10_url_filter}
ORACLES = {"op10_url_filter": _oracle()}
