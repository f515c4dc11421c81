"""URL filter: host rules, then a weighted vocabulary.

An Aho-Corasick automaton finds the vocabulary's terms in the lower-cased URL in
one pass, whatever their number; percent-coded characters are decoded first. A
hit counts only between boundaries (no ASCII letter or digit beside it). One strict term rejects; so do several distinct soft
ones. A host rule that fits overrides the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower

#: Terms that reject alone, and terms of which SOFT_HITS distinct ones do. Defaults; a table of own
#: terms goes in by ``vocabulary_of``. Soft terms are words that are rare in addresses of ordinary
#: shops and media, so that two of them mean something.
STRICT = (
    "porn", "porno", "pornos", "pornhub", "pornstar", "pornstars", "porntube", "xxx", "xxxvideos", "hentai", "nsfw", "camgirl", "camgirls", "sexcam", "sexcams", "livesex", "escort", "escorts",
    "callgirl", "callgirls", "milf", "milfs", "gangbang", "blowjob", "handjob", "creampie", "bukkake", "upskirt", "fuck", "fucking", "xvideos", "xhamster", "redtube", "youporn", "viagra", "cialis",
    "levitra", "kamagra", "warez", "keygen", "keygens", "nulled", "crackz", "serialz", "adult-x", "spam-farm", "ads-track", "link-farm", "linkfarm", "doorway-page", "payday-loans", "replica-watches",
)
SOFT = (
    "adult", "adults", "amateur", "anal", "babes", "bdsm", "bigtits", "boobs", "busty", "casino", "casinos", "cumshot", "dating", "dildo", "erotic", "erotica", "erotik", "fetish", "gamble", "gambling",
    "hardcore", "hookup", "hookups", "horny", "jackpot", "jackpots", "kinky", "lesbian", "lingerie", "lolita", "lottery", "loan", "loans", "naked", "naughty", "nude", "nudes", "nudist", "orgasm",
    "orgy", "payday", "pharma", "pills", "poker", "pussy", "roulette", "seduce", "sex", "sexe", "sexo", "sexshop", "sexy", "shemale", "slots", "slut", "sluts", "softcore", "spam", "strip", "striptease",
    "swinger", "swingers", "tits", "torrent", "torrents", "voyeur", "webcam", "webcams", "whore", "xvideo",
)
SOFT_HITS = 2
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


_LOW = str.maketrans(UPPER, LOWER)


def vocabulary_of(terms: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) terms from a table ``(term, weight)`` of a vocabulary: weight
    1 and more is strict, less is soft; null or empty terms are left out. The
    driver holds the vocabulary, which is a parameter and no data."""
    rows = terms.where("term <> '' and weight > 0").select(ascii_lower(F.col("term")).alias("term"), "weight").distinct().orderBy("term").collect()
    return tuple(r.term for r in rows if r.weight >= 1), tuple(r.term for r in rows if r.weight < 1)


def automaton(strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def term_hits(url: str, found: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict and distinct soft terms of a lower-cased URL."""
    strict, soft = set(), set()
    for end, (term, hard) in found.iter(url):
        start = end - len(term)
        if (start < 0 or url[start] not in _WORD) and (end + 1 == len(url) or url[end + 1] not in _WORD):
            (strict if hard else soft).add(term)
    return len(strict), len(soft)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: then
    up to ``? #``. Both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """Per row: id, host, path, rule, verdict, ``strict_hits``, ``soft_hits``.

    A null or empty URL has no hits and is allowed; one of any length is read
    whole. Of rules that fit and are equally long the later in ``rules`` wins.
    Null ids stay null; repeated rows give repeated results; an empty table gives
    an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(strict, soft)
        for batch in batches:
            hits = [term_hits(unquote(u or "").translate(_LOW), found) for u in batch.column("raw").to_pylist()]
            strict_n, soft_n = (pa.array([h[i] for h in hits], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path", "rule", "ruled")), strict_n, soft_n], names=["id", "host", "path", "rule", "ruled", "strict_hits", "soft_hits"])

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"), F.col("url").alias("raw"))
    rule, ruled = rule_column(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": ruled})
    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, ruled string, strict_hits long, soft_hits long")
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_hits), "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "strict_hits", "soft_hits")
