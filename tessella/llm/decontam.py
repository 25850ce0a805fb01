"""Benchmark decontamination by spaced seeds, in DataFrame expressions only.

A seed mask selects some of the word positions of a span and ignores the others, so a hash over the selected words still agrees where an ignored word
was substituted. Hashes of test items and of documents are joined; each hit is then verified by comparing the aligned words around it.

Three masks of six words, none of them in a row, laid at every place, hit every span that verification accepts: of 11 aligned words with any two substituted, one of the masks leaves both out at some
place (the tests try all). All masks begin with two neighbouring words, so a place is only looked at closely if the test items hold that pair. Items of fewer than 11 words have to be copied whole and are
seeded by all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, distinct_name, staged

#: 1 selects the word at that place; all begin with PAIR. Together they hit SHORTEST aligned words with any WINDOW - AGREE of them substituted.
COVER, PAIR = ("1111011", "1101100011", "110001111"), "11"
#: Fewest aligned words in which substitutions are allowed.
SHORTEST = 11
#: Verified words around a hit, and how many of them have to agree.
WINDOW, AGREE = 15, 13
#: log2 of the longs in the filter that goes with the plan: at least, and at most. In between there are 64 bits and more for each seed. The filter only saves rows.
FILTER_LONGS = (14, 17)
#: Words of test items that are broadcast, at most; more are shuffled.
BROADCAST_WORDS = 2_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words (separated by 0x20 and 0x09-0x0D)."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *(F.get(words, at + i) for i, c in enumerate(mask) if c == "1"))


def _starts(words: Column, mask: str) -> Column:
    """Where the mask fits; no place where there are too few words."""
    last = F.size(words) - len(mask)
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))


def numbered(items: DataFrame) -> DataFrame:
    """(item, item_id, words): the items that have words, with a number of their own."""
    return items.select(F.monotonically_increasing_id().alias("item"), "item_id", word_hashes(F.col("text")).alias("words")).where(F.size("words") > 0)


def item_seeds(items: DataFrame) -> DataFrame:
    """(item, item_start, seed) of every place of every numbered item; of the first place alone, over all words, where there are fewer than SHORTEST."""

    def places(mask: str) -> Column:
        return F.transform(_starts(F.col("words"), mask), lambda i: F.struct(i.alias("item_start"), _seed(F.col("words"), i, mask).alias("seed")))

    each = F.concat(*map(places, COVER))
    for n in range(1, SHORTEST):
        each = F.when(F.size("words") == n, places("1" * n)).otherwise(each)
    return items.select("item", F.inline(each))


def seed_filter(seeds: DataFrame) -> tuple[Column, int]:
    """(array literal with a bit for each seed, log2 of its length); the driver gets that many numbers at most."""
    least, most = FILTER_LONGS
    size = min(max(least, seeds.count().bit_length()), most)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("seed").bitwiseAND(F.lit(63)).cast("int"))
    got = seeds.groupBy(F.shiftrightunsigned("seed", 64 - size).cast("int").alias("place")).agg(F.bit_or(bit).alias("bits")).collect()
    longs = [0] * (1 << size)
    for r in got:
        longs[r["place"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>"), size


def may(held: tuple[Column, int], h: Column) -> Column:
    """Whether a filter may hold a seed."""
    bits, size = held
    return F.getbit(F.get(bits, F.shiftrightunsigned(h, 64 - size).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, agree): documents that share words with a test item; agree: the most equal words among WINDOW aligned ones around a hit.

    docs has doc_id and text, items has item_id and text. A hit counts if AGREE of WINDOW aligned words agree, or all but WINDOW - AGREE where the item or the document has
    fewer words, but SHORTEST at least are aligned. Items of fewer words than that count where all their words are copied; a document of fewer words, which is only a part
    of a longer item, doesn't count. Words are compared in lower case. Whole texts are searched; nulls and empty texts have no words;
    rows with one doc_id count as one document, as do those with a null one; an empty table on either side gives no row; other columns are ignored.
    """
    items = staged(spark, numbered(items), "items")
    seeds = staged(spark, item_seeds(items), "seeds")
    held = seed_filter(seeds)
    pairs = seed_filter(items.where(F.size("words") >= SHORTEST).select(F.explode(F.transform(_starts(F.col("words"), PAIR), lambda i: _seed(F.col("words"), i, PAIR))).alias("seed")).distinct())
    # At most SHORTEST numbers reach the driver.
    short = sorted(r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n") < SHORTEST).distinct().collect())
    least = min([SHORTEST, *short])
    words = docs.select("doc_id", word_hashes(F.col("text")).alias("words")).where(F.size("words") >= least)

    def hits_of(mask: str, starts: Column) -> Column:
        seed = lambda i: _seed(F.col("words"), i, mask)
        # exists() over one element names the hash, so that it is computed once for each place.
        hit = F.filter(starts, lambda i: F.exists(F.array(seed(i)), lambda h: may(held, h)))
        near = lambda i: F.slice(F.col("words"), F.greatest(i - WINDOW, F.lit(0)) + 1, F.lit(3 * WINDOW))
        return F.transform(hit, lambda i: F.struct((i - WINDOW).alias("from"), seed(i).alias("seed"), near(i).alias("near")))

    known_pair = F.filter(_starts(F.col("words"), PAIR), lambda i: F.exists(F.array(_seed(F.col("words"), i, PAIR)), lambda h: may(pairs, h)))
    fits = lambda mask, places: F.filter(places, lambda i: i <= F.size("words") - len(mask))
    spaced = F.flatten(F.transform(F.array(known_pair), lambda places: F.concat(*(hits_of(m, fits(m, places)) for m in COVER))))
    whole = [hits_of("1" * n, _starts(F.col("words"), "1" * n)) for n in short]
    hits = words.select("doc_id", F.inline(F.concat(spaced, *whole)))
    if seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    known = items.select("item", "item_id", F.col("words").alias("its"))
    if (known.agg(F.sum(F.size("its"))).first()[0] or 0) <= BROADCAST_WORDS:
        known = F.broadcast(known)
    met = hits.join(seeds, "seed").join(known, "item")
    # Aligned words: the document's at start + d and the item's at item_start + d, for d from -WINDOW.
    offset = F.sequence(F.lit(-WINDOW), F.lit(2 * WINDOW - 1))
    skipped = F.least(F.col("from"), F.lit(0))  # what is missing at the document's beginning
    equal = F.transform(offset, lambda d: (F.get("its", F.when(F.col("item_start") + d >= 0, F.col("item_start") + d)) == F.get("near", F.when(d + WINDOW + skipped >= 0, d + WINDOW + skipped))).cast("int"))
    met = met.select("doc_id", "item_id", F.size("its").alias("n"), F.filter(equal, lambda e: e.isNotNull()).alias("equal"))
    met = met.withColumn("most", F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size("equal") - WINDOW + 1, F.lit(1))), lambda s: F.aggregate(F.slice("equal", s, WINDOW), F.lit(0), lambda a, e: a + e))))
    worn = (F.size("equal") >= SHORTEST) & (F.col("most") >= F.least(F.size("equal"), F.lit(WINDOW)) - (WINDOW - AGREE))
    found = met.where(F.when(F.col("n") < SHORTEST, F.col("most") == F.col("n")).otherwise(worn))
    return found.groupBy("doc_id", "item_id").agg(F.max("most").cast("long").alias("agree"))


def clean_documents(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that share no test item, with the columns of docs as they are, whatever their names.

    Texts decide, so repeated rows and rows with one doc_id each stay or go by their own text; rows without words stay; an empty table on either side removes nothing.
    """
    gone, at = distinct_name(docs, "_bad"), distinct_name(docs, "_at")
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    bad = staged(spark, contaminated(spark, keyed, items).select(F.col("doc_id").alias(gone)).distinct(), "contaminated")
    if bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.withColumn(at, F.xxhash64("text")).join(bad, F.col(at) == F.col(gone), "left_anti").select(*docs.columns)
