"""URL filter: host and path rules first, then a weighted vocabulary counted by one Aho-Corasick automaton."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: (host, path, verdict): a rule fits its host and all subdomains where the URL's path starts with the rule's.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: One of these rejects a URL.
STRICT = "adult casino casinos cialis escort escorts hentai milf nude nudes porn porno pornos sexcam sexcams slots viagra xxx".split()
#: Of these, different ones must meet.
SOFT = """
ads advert banner bet bets betting bonus cam cams cheap click clicks coupon coupons deal deals discount download downloads earn farm free girls hot jackpot
keygen loan loans meds money pharmacy pills poker popup proxy replica sex sexy spam sponsor sweepstakes torrent torrents track tracker warez win winner
""".split()
#: Term weights and the sum over a URL's different terms that rejects it.
WEIGHTS = {**dict.fromkeys(SOFT, 1), **dict.fromkeys(STRICT, 2)}
LIMIT = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The name (host and path) and the verdict of the longest rule that fits, null where none does; of equally long
    ones the first. The rules are part of the plan: a list of some hundreds at most."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=False):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


@lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    own = ahocorasick.Automaton()
    for t in terms:
        own.add_word(t, t)
    own.make_automaton()
    return own


def _letter(c: str) -> bool:
    return "a" <= c <= "z" or c >= "\x80"


def found(url: str, terms: tuple[str, ...]) -> set[str]:
    """The different terms of a lower-cased URL that no letter touches; characters beyond ASCII count as letters."""
    hits = ((e + 1 - len(t), e + 1, t) for e, t in _automaton(terms).iter(url))
    return {t for b, e, t in hits if not (b and _letter(url[b - 1])) and not (e < len(url) and _letter(url[e]))}


def judge(pages: DataFrame, rules=RULES, weights: dict[str, int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, n_strict, n_soft.

    The longest rule that fits decides. Where none does, the terms of the whole URL do: it is blocked if the weights of
    its different terms sum up to ``limit``, which one strict term or two soft ones reach. n_strict and n_soft count
    different terms of the limit's weight or more, and of less, whichever decides.

    A null URL and one without ``://`` have an empty host and path and fit no rule; a null or empty one is allowed. A
    null page_id stays null, repeated rows give a row each, an empty table none; long URLs are read whole, other columns
    are not read. Rows stay in their partition; the automaton is built in each worker.
    """
    terms = tuple(sorted(weights))

    def count(batches):
        for b in batches:
            sets = [found(u, terms) for u in b.column("_url").to_pylist()]
            strict = [sum(weights[t] >= limit for t in s) for s in sets]
            total = [sum(weights[t] for t in s) for s in sets]
            kept = b.drop_columns(["_url"])
            yield pa.record_batch([*kept.columns, pa.array(strict, pa.int64()), pa.array([len(s) - n for s, n in zip(sets, strict, strict=True)], pa.int64()), pa.array(total, pa.int64())], names=[*kept.schema.names, "n_strict", "n_soft", "total"])

    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"), F.translate(url, _UPPER, _LOWER).alias("_url"))
    seen = parts.mapInArrow(count, "page_id long, host string, path string, n_strict long, n_soft long, total long")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return seen.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("total") >= limit, "block").otherwise("allow")).alias("verdict"), "n_strict", "n_soft")
