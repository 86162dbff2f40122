"""Local indicator feeds and their join with links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import let

FEED_POINTS = 70


def read_feed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """feed, indicator (lower case, distinct): lines without ``#`` comments, or JSON, a list or an object with ``indicators``."""
    if path.lower().endswith(".json"):
        text = spark.read.option("wholetext", True).text(path)
        listed = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "struct<indicators:array<string>>")["indicators"])
        lines = text.select(F.explode(listed).alias("line"))
    else:
        lines = spark.read.text(path).select(F.col("value").alias("line")).where("ltrim(line) NOT LIKE '#%'")
    return lines.select(F.lit(name).alias("feed"), F.lower(F.trim("line")).alias("indicator")).where("indicator != ''").distinct()


#: Words of 64 bits of the filter: half a megabyte, whatever the feed's size. A feed of many millions fills it, and then all rows go on.
WORDS = 1 << 16


def _spot(indicator: Column) -> Column:
    return F.pmod(F.xxhash64(indicator), F.lit(64 * WORDS))


def seen_bits(feed: DataFrame) -> DataFrame:
    """One row with the filter of a feed's indicators: bits, an array of WORDS whole numbers."""
    spot = _spot(F.col("indicator"))
    held = feed.groupBy(F.shiftright(spot, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int"))).alias("bits"))
    every = feed.sparkSession.range(0, WORDS, 1, 1).select(F.col("id").cast("int").alias("word"))
    dense = every.join(held, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))


def maybe_listed(indicator: Column, bits: Column) -> Column:
    """False only where the feed can't hold the indicator."""
    # behind a lambda, so that the many checks of links before it stay in a generated method of their own, small enough to compile
    spot = let(_spot(indicator), lambda s: s)
    return F.getbit(F.get(bits, F.shiftright(spot, 6).cast("int")), F.pmod(spot, F.lit(64)).cast("int")) == 1


def matches(links: DataFrame, feed: DataFrame, key: str, url: str = "normalized_url", host: str = "host") -> DataFrame:
    """key, feed, indicator: for each link and feed the least of its address, host and SHA-256 that the feed holds.

    A filter of the feed, a subquery that runs once, keeps needles that it can't
    hold out of the shuffle; the equality join on the indicator decides, and
    Spark broadcasts the feed there only if its measured size allows it.
    """
    needles = links.select(key, F.explode(F.array_distinct(F.array(F.lower(url), F.lower(host), F.sha2(F.col(url), 256)))).alias("indicator"))
    bits = seen_bits(feed).scalar()
    return needles.where(maybe_listed(F.col("indicator"), bits)).join(feed, "indicator").groupBy(key, "feed").agg(F.min("indicator").alias("indicator"))
