"""URL filter: host and path rules, and a logistic regression on hashed character n-grams for all other URLs.

The regression is trained on the driver from a small labelled table of hosts and paths; its weights (one for each of
`BUCKETS` places) are a literal in the plan, and everything over the pages is DataFrame functions.

A null URL, or one without `://`, has an empty host and path; these are judged like any other: no rule fits, and the
regression sees its constant alone. Rows are judged one by one, so repeated rows repeat their result and null ids keep
theirs; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
BUCKETS = 4096
GRAM = 4
#: Labelled names of hosts, chosen by what such sites are called; each is joined with some domains and paths below.
UNWANTED = (
    "casino-bonus", "free-casino", "casino-slots", "online-casino", "win-prize", "prize-draw", "lottery-win", "jackpot-win", "click-ads", "adserver", "popup-ads", "ads-network", "track-clicks",
    "clicktracker", "track-pixel", "pills-online", "buy-pills", "cheap-viagra", "cheap-watches", "cheap-replica", "spam-links", "spammail", "link-farm", "content-farm", "seo-links", "seo-boost",
    "xxx-videos", "xxx-cams", "hot-dating", "adult-dating", "adult-cams", "payday-loans", "fast-loans", "crack-keygen", "torrent-warez", "free-warez",
)
WANTED = (
    "encyclopedia", "weather", "library", "university", "museum", "garden", "recipes", "newsroom", "theatre", "history", "science", "travel", "school", "bakery", "cycling", "thermal", "reading",
    "orchestra", "village", "chemistry", "parliament", "hospital", "northern-times", "daily-herald", "botany", "railway", "pottery", "language-notes", "old-maps", "harbour", "sailing", "astronomy",
    "geology-club", "city-archive", "county-court", "grammar", "children-books", "mountain-hut", "river-trust", "heritage", "fisheries", "meteorology", "philosophy", "mathematics", "poetry-house",
    "art-gallery", "choir", "woodwork", "knitting", "birdwatch", "bee-keeping", "local-council", "fire-brigade", "the-tribune", "open-lectures", "letters", "nature-reserve", "public-health",
    "rowing", "chess", "gymnasium", "opera-house", "the-observer", "vineyard", "cathedral", "lighthouse", "dictionary", "forestry", "station-road", "physics", "nursery", "cookery",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    head = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(head) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(head, UPPER, LOWER), path


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits, and its verdict; null without any."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def places(host: str, path: str) -> list[int]:
    """The hashed n-grams of a host and a path, as the plan below computes them."""
    out = []
    for tag, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        out += [zlib.crc32((tag + text[i : i + GRAM]).encode()) % BUCKETS for i in range(len(text) - GRAM + 1)]
    return out


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, unwanted): the small labelled table."""
    tops, starts, paths = ("example.com", "example.net", "example.org"), ("", "www.", "m.", "blog."), ("/en/12", "/fr/345.html", "/de/67/", "/es/890")
    rows = []
    for label, names in ((1, UNWANTED), (0, WANTED)):
        for i, name in enumerate(names):
            rows += [(f"{starts[(i + k) % 4]}{name}.{tops[(i + k) % 3]}", paths[(i + 2 * k) % 4], label) for k in range(4)]
    return rows


def fitted(rows: list[tuple[str, str, int]], rounds: int = 100, rate: float = 0.5, decay: float = 1e-4) -> tuple[tuple[float, ...], float]:
    """(weights, constant) of the regression: gradient descent over labelled rows (host, path, unwanted), in an order of their own."""
    table = [(places(h, p), y) for h, p, y in sorted(rows, key=lambda r: zlib.crc32("".join(r[:2]).encode()))]
    w, b = [0.0] * BUCKETS, 0.0
    for _ in range(rounds):
        for grams, y in table:
            share = 1 / math.sqrt(max(1, len(grams)))
            z = b + share * sum(w[g] for g in grams)
            d = rate * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            b -= 0.1 * d
            for g in grams:
                w[g] -= d * share + rate * decay * w[g]
    return tuple(round(x, 6) for x in w), round(b, 6)


@functools.cache
def weights() -> tuple[tuple[float, ...], float]:
    """(weights, constant) learned from the whole labelled table."""
    return fitted(labelled_urls())


def score_of(host: str, path: str, model: tuple[tuple[float, ...], float]) -> float:
    """The regression's probability in plain Python."""
    grams = places(host, path)
    return 1 / (1 + math.exp(-(model[1] + sum(model[0][g] for g in grams) / math.sqrt(max(1, len(grams))))))


def unwanted_score(host: Column, path: Column) -> Column:
    """The regression's probability that a URL is unwanted."""
    values, constant = weights()
    table = F.array(*[F.lit(x) for x in values])

    def grams(tag: str, text: Column) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.when(F.length(framed) >= GRAM, F.sequence(F.lit(1), F.length(framed) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.crc32(F.encode(F.concat(F.lit(tag), F.substring(framed, i, F.lit(GRAM))), "utf-8")), F.lit(BUCKETS)).cast("int"))

    all_grams = F.concat(grams("h", host), grams("p", path))
    total = F.aggregate(all_grams, F.lit(0.0), lambda s, g: s + F.get(table, g))
    z = F.lit(constant) + total / F.sqrt(F.greatest(F.size(all_grams), F.lit(1)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def judge_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of pages(page_id, url)."""
    host, path = host_and_path(F.col("url").cast("string"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    out = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), unwanted_score(F.col("host"), F.col("path")).alias("score"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
