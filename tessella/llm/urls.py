"""URL filter: rules by host and path, and logistic regression on hashed character n-grams for what no rule decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .words import VALUE, U, _bytes, mix

#: (verdict, host, path) of each rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: The labelled table: words that name kinds of sites, written down by category, in names of a few common forms. Both sides get the same forms and paths in turn, so
#: that it is the words that tell. There are more wanted names than unwanted ones, so a name that says nothing is let through.
FORMS = (
    "http://{}.com/en/1", "https://www.{}.net/de/22", "https://{}.org/2021/03/page.html", "http://m.{}.com/fr/7/", "https://blog.{}.net/item?id=4", "https://{}.example.org/en/9#top", "http://{}.example.com/es/318",
    "https://{}.info/a/b/c", "https://{}.example.net/", "https://www.{}.org/news/", "http://{}.net/index",
)
AFFIXES = ("{}", "{}-online", "my{}", "{}24", "the-{}", "{}-club", "best-{}", "{}-now", "{}zone", "e{}", "{}-world", "{}s", "go-{}", "grand-{}", "{}-house", "green{}", "{}-point", "old-{}", "{}corner", "blue-{}", "{}base", "first{}", "{}-guide", "little-{}", "{}-plus")
UNWANTED_WORDS = {
    "gambling": ("casino", "poker", "roulette", "blackjack", "baccarat", "slots", "jackpot", "betting", "sportsbook", "bookmaker", "bingo", "lotto"),
    "adult": ("porn", "xxx", "sex", "nude", "escort", "fetish", "erotic", "hookup", "striptease", "adult"),
    "medicines": ("viagra", "cialis", "xanax", "tramadol", "pills", "steroids", "slimming", "painkillers"),
    "money": ("payday", "loans", "quickcash", "forex", "doubler", "giveaway", "moneymaker"),
    "fakes": ("replica", "counterfeit", "knockoff", "fakeid", "essaymill"),
    "copies": ("warez", "torrent", "keygen", "cracked", "nulled", "serialz", "camrip"),
    "fraud": ("phishing", "malware", "trojan", "spyware", "ransom", "lottowinner", "hacktool"),
    "advertising": ("adserver", "adclick", "popunder", "banners", "clickbait", "tracker", "ads", "affiliate"),
    "mail": ("spam", "bulkmail", "mailbomb", "backlinks", "seoboost"),
}
WANTED_WORDS = {
    "learning": ("university", "college", "school", "library", "course", "lecture", "grammar", "archive", "dictionary", "academy", "teacher", "student"),
    "public": ("council", "ministry", "parliament", "embassy", "court", "census", "police", "firebrigade", "townhall", "statistics"),
    "health": ("hospital", "clinic", "dentist", "nursing", "surgery", "physiotherapy", "hospice", "midwife", "nutrition"),
    "news": ("gazette", "herald", "tribune", "weather", "magazine", "radio", "newspaper", "podcast", "journal"),
    "science": ("physics", "botany", "astronomy", "geology", "chemistry", "mathematics", "ecology", "archaeology", "laboratory", "telescope"),
    "arts": ("theatre", "museum", "gallery", "orchestra", "poetry", "ballet", "sculpture", "choir", "opera", "painting", "pottery"),
    "sport": ("cycling", "rowing", "tennis", "climbing", "swimming", "athletics", "chess", "football", "hiking", "sailing"),
    "travel": ("hostel", "railway", "ferry", "atlas", "airport", "campsite", "timetable", "harbour", "caravan", "guidebook"),
    "home": ("garden", "kitchen", "carpentry", "knitting", "recipes", "furniture", "plumbing", "bicycle", "sewing", "bakery"),
    "computing": ("compiler", "database", "kernel", "software", "network", "programming", "opensource", "manuals", "keyboard", "robotics"),
    "community": ("parish", "charity", "scouts", "village", "volunteers", "neighbours", "orphanage", "foodbank", "youthgroup", "congregation"),
    "business": ("accounting", "bookshop", "insurance", "logistics", "brewery", "architects", "engineering", "translation", "printing", "warehouse", "solicitors", "vineyard"),
    "nature": ("birds", "forest", "river", "mountain", "meadow", "seashore", "wildlife", "beekeeping", "orchard", "glacier", "butterfly"),
    "past": ("history", "castle", "genealogy", "monastery", "heritage", "antiques", "folklore", "medieval"),
}


def listed(words: dict[str, tuple[str, ...]], each: int) -> tuple[str, ...]:
    """URLs of `each` names of every word."""
    every = [w for group in words.values() for w in group]
    names = [AFFIXES[(each * i + j) % len(AFFIXES)].format(word) for i, word in enumerate(every) for j in range(each)]
    return tuple(FORMS[i % len(FORMS)].format(name) for i, name in enumerate(names))


UNWANTED, WANTED = listed(UNWANTED_WORDS, 8), listed(WANTED_WORDS, 6)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end. Both empty without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(url, pattern, 2)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of rules of one length the first listed."""
    found: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def key_of(host: Column, path: Column) -> Column:
    """UrlModel.key as an expression."""
    return F.concat(F.lit("^"), F.translate(F.concat(host, path), "123456789", "000000000"), F.lit("$"))


def ngram_features(texts: pa.Array, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each distinct hashed n-gram of each text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    buf = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    up, down = _bytes.get(len(buf) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(VALUE[buf] * up[: len(buf)])])
    found = []
    for n in sizes:
        at = np.arange(max(0, len(buf) - n + 1))
        at = at[at + n <= ends[owner[at]]] if len(at) else at
        bucket = mix((sums[at + n] - sums[at]) * down[at] + U(n)) >> U(64 - bits)
        found.append(owner[at].astype(np.int64) << bits | bucket.astype(np.int64))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> bits, both & ((1 << bits) - 1)


@dataclass
class UrlModel:
    """Logistic regression; score() is the probability that a URL is unwanted."""

    sizes: tuple[int, ...] = (3, 4)
    bits: int = 14
    l2: float = 1e-4
    steps: int = 3000
    rate: float = 1.0

    @staticmethod
    def key(host: str, path: str) -> bytes:
        """Digits carry no meaning in a host or path, so each becomes 0."""
        return ("^" + "".join("0" if "0" <= c <= "9" else c for c in f"{host}{path}") + "$").encode("utf-8", "surrogatepass")

    def fit(self, unwanted: list[bytes], wanted: list[bytes]) -> "UrlModel":
        keys = [*unwanted, *wanted]
        y = np.r_[np.ones(len(unwanted)), np.zeros(len(wanted))]
        row, col = ngram_features(pa.array(keys, pa.binary()), self.sizes, self.bits)
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(keys))))
        self.w, self.b = np.zeros(1 << self.bits), 0.0
        for _ in range(self.steps):
            z = np.bincount(row, self.w[col], len(keys)) * scale + self.b
            g = (1 / (1 + np.exp(-z)) - y) / len(keys) * 4
            self.w -= self.rate * (np.bincount(col, g[row] * scale[row], len(self.w)) + self.l2 * self.w)
            self.b -= self.rate * g.sum()
        return self

    def score(self, keys: list[bytes] | pa.Array) -> np.ndarray:
        row, col = ngram_features(keys if isinstance(keys, pa.Array) else pa.array(keys, pa.binary()), self.sizes, self.bits)
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(keys))))
        return np.round(1 / (1 + np.exp(-(np.bincount(row, self.w[col], len(keys)) * scale + self.b))), 9)


def split_text(url: str) -> tuple[str, str]:
    """split_url for the labelled table."""
    rest = url.partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[cut:].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail


@cache
def shipped() -> UrlModel:
    """The model of the table above, fitted once in a driver."""
    return train()


def train(unwanted=UNWANTED, wanted=WANTED, **parameters) -> UrlModel:
    key = lambda url: UrlModel.key(*split_text(url))
    return UrlModel(**parameters).fit([*map(key, unwanted)], [*map(key, wanted)])


def judge_urls(pages: DataFrame, page: str = "page_id", url: str = "url", rules=RULES, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    verdict is the longest rule's, else block where score reaches the threshold. A null URL, or one without ://, has empty host and path and is
    scored as such. Repeated rows are each judged; other columns are ignored; an empty table gives no row.
    """
    model = model or shipped()
    host, path = split_url(F.col(url))
    split = pages.select(F.col(page).alias("page_id"), host.alias("host"), path.alias("path"), key_of(host, path).alias("key"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").cast(pa.binary())
            # A batch may hold very long URLs; a few thousand are scored at a time.
            scores = [model.score(keys.slice(at, 2000)) for at in range(0, len(keys), 2000)]
            yield b.select(["page_id", "host", "path"]).append_column("score", pa.array(np.concatenate([*scores, np.zeros(0)]), pa.float64()))

    split = map_arrow(split, scored, f"page_id {dict(split.dtypes)['page_id']}, host string, path string, score double")
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return split.withColumn("r", rule).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", learnt).alias("verdict"), "score")
