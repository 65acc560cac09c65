"""URL filter: host rules first, then a weighted vocabulary found by Aho-Corasick.

Strict terms reject a url alone. Soft terms reject it together: SOFT_HITS different ones or more
whose weights add up to SOFT_WEIGHT. A term stands between boundaries: an end of the url or any
character but a-z and 0-9, after A-Z are lower-cased.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tables import fresh


class Term(NamedTuple):
    """``forms`` are written alike for one term, which counts once; ``host`` terms count in the host only."""

    name: str
    strict: bool
    weight: int
    host: bool
    forms: tuple[str, ...]


def _terms(lines: str, strict: bool = False, weight: int = 1, host: bool = False) -> list[Term]:
    return [Term(forms[0], strict, weight, host, tuple(forms)) for forms in (line.split() for line in lines.strip().splitlines())]


#: The vocabulary that holds unless a table is given; a line is a term and its other forms. Casino, adult and
#: advertising words are common in paths and queries of clean hosts, so they are held against hosts only.
VOCABULARY = [
    *_terms("porn porno pornos\nxxx\nhentai\nescort escorts\ncamgirl camgirls\nmilf milfs\nviagra\ncialis\nlevitra\ncheap-pills\nwarez\nkeygen keygens\nphishing\nmalware\nbotnet botnets\nspam-farm spam-farms\nlink-farm link-farms", strict=True),
    *_terms("casino casinos\nadult adults", strict=True, host=True),
    *_terms("casino casinos\nadult adults", weight=3),
    *_terms(
        "cheap cheapest\npill pills\npharmacy pharmacies\nmeds\nbet bets betting bettor bettors\npoker\nslot slots\nroulette\nblackjack\njackpot jackpots\nlottery lotteries\nbonus bonuses\nprize prizes\n"
        "winner winners win wins winning winnings\ndating\nnude nudes\nsex sexy\nloan loans\npayday\nforex\nreplica replicas\ntorrent torrents\ncrack cracks cracked\nhack hacks\nbacklink backlinks\ngiveaway giveaways\nspam",
        weight=2,
    ),
    *_terms("ads adserver adservers advert adverts\ntrack tracks tracker trackers tracking", weight=2, host=True),
    *_terms("free\nclick clicks\ndiscount discounts discounted\ncoupon coupons\npromo promos\nsale sales\noffer offers\ndeal deals\ncredit credits\ndebt debts\nserial serials\ncheat cheats\ncrypto\nmiracle\ndiet diets\nsingles\nseo"),
]
SOFT_HITS, SOFT_WEIGHT = 2, 3
#: Terms in all forms that a vocabulary may have; the automaton goes to every task.
MOST_FORMS = 100_000
#: (host, path, verdict); the longest that fits wins.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

_LOWER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and path; both empty for null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    none = F.lit("")
    return (F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), none), F.coalesce(path, none))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path joined, and its verdict; null without one."""
    name = said = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, said = F.when(fits, h + p).otherwise(name), F.when(fits, verdict).otherwise(said)
    return name, said


def vocabulary_of(table: DataFrame) -> list[Term]:
    """Terms from table(name, form, strict, weight, host), a row for each form; at most MOST_FORMS rows, no null."""
    rows = table.select("name", "form", "strict", "weight", "host").limit(MOST_FORMS + 1).collect()
    if len(rows) > MOST_FORMS or any(v is None for r in rows for v in r):
        raise ValueError(f"a vocabulary has at most {MOST_FORMS} rows and no nulls")
    terms: dict[tuple, list[str]] = {}
    for name, form, strict, weight, host in rows:
        terms.setdefault((name, strict, weight, host), []).append(form.translate(_LOWER))
    return [Term(*key, tuple(sorted(forms))) for key, forms in sorted(terms.items())]


def vocabulary_hits(vocabulary: list[Term]):
    """A function from urls to struct<strict, soft, weight>: different strict and soft terms, and the soft ones' weights."""
    machine = []

    def hits(urls: pd.Series) -> pd.DataFrame:
        import ahocorasick

        if not machine:
            means: dict[str, list] = {}
            for t in vocabulary:
                for form in t.forms:
                    means.setdefault(form, []).append(t)
            built = ahocorasick.Automaton()
            for form, terms in means.items():
                built.add_word(form, (form, terms))
            if means:
                built.make_automaton()
            machine.append(built)
        out = []
        for url in urls:
            strict, soft = set(), {}
            low = (url or "").translate(_LOWER)
            at = low.find("://") + 3
            to = at + len(re.split("[/?#]", low[at:], maxsplit=1)[0]) if at > 2 else -1
            for end, (form, terms) in machine[0].iter(low) if len(machine[0]) else ():
                start = end + 1 - len(form)
                if (start == 0 or not _inner(low[start - 1])) and (end + 1 == len(low) or not _inner(low[end + 1])):
                    for t in terms:
                        if not t.host or at <= start and end < to:
                            if t.strict:
                                strict.add(t.name)
                            else:
                                soft[t.name] = max(t.weight, soft.get(t.name, 0))
            out.append((len(strict), len(soft), sum(soft.values())))
        return pd.DataFrame(out, columns=["strict", "soft", "weight"], dtype="int64")

    return F.pandas_udf(hits, "strict long, soft long, weight long")


def _inner(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def judged(pages: DataFrame, url: str = "url", vocabulary: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule, strict_hits, soft_hits, soft_weight and verdict.

    The rule's verdict holds, else that of the vocabulary (VOCABULARY, or a table as in
    ``vocabulary_of``). Null, empty and malformed urls have no host, path or rule; null and
    empty ones also no hits, so they are allowed. Each row is judged alone, so repeated rows
    fare alike, urls of any length are searched whole, and an empty table stays empty. Columns
    of these names in ``pages`` are replaced.
    """
    terms = VOCABULARY if vocabulary is None else vocabulary_of(vocabulary)
    hits, said_name = fresh(pages, "hits_"), fresh(pages, "said_")
    host, path = host_and_path(F.col(url).cast("string"))
    rows = pages.withColumns({"host": host, "path": path, hits: vocabulary_hits(terms)(F.col(url).cast("string"))})
    rule, said = rule_for(F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "strict_hits": F.col(f"{hits}.strict"), "soft_hits": F.col(f"{hits}.soft"), "soft_weight": F.col(f"{hits}.weight"), said_name: said})
    bad = (F.col("strict_hits") >= 1) | (F.col("soft_hits") >= SOFT_HITS) & (F.col("soft_weight") >= SOFT_WEIGHT)
    return rows.withColumn("verdict", F.coalesce(said_name, F.when(bad, "block").otherwise("allow"))).drop(said_name, hits)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    def hit(t: Term) -> str:
        return f"regexp_matches({'host' if t.host else 'u'}, '(^|[^a-z0-9])({'|'.join(map(re.escape, t.forms))})($|[^a-z0-9])')"

    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda value: "CASE" + "".join(f" WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in ordered) + " END"
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    soft = [t for t in VOCABULARY if not t.strict]
    return f"""
WITH cut AS (SELECT page_id, {low} AS u, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
found AS (SELECT *, {' OR '.join(hit(t) for t in VOCABULARY if t.strict)} AS strict, {' + '.join(f'{hit(t)}::INT' for t in soft)} AS soft, {' + '.join(f'{t.weight} * {hit(t)}::INT' for t in soft)} AS weight FROM parts)
SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule,
    coalesce({case(lambda h, p, v: v)}, CASE WHEN strict OR soft >= {SOFT_HITS} AND weight >= {SOFT_WEIGHT} THEN 'block' ELSE 'allow' END) AS verdict
FROM found
"""


OP4_SQL = _sql()
