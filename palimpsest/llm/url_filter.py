"""URL filters: a blocked Bloom filter in front of an exact hash join.

A list holds (host, path, verdict) and perhaps a priority: an entry fits its host and all subdomains
of it, if a URL's path starts with the entry's. A URL's canonical form is its host (A-Z in lower case)
and its path; from it come the keys that entries could have: each run of trailing labels with each
beginning of the path, of numbers and lengths that the list has. A key's hash names one block of 256
bits of the filter and eight bits in it, so a probe is a lookup of one row. Keys with all eight bits
set are possible hits; an exact join with the list drops the false ones. Of fitting entries the one
with the greatest priority, then the longest host, then the longest path decides; URLs without one
are allowed.

All is done in the JVM. The filter is broadcast up to BROADCAST_BLOCKS blocks; beyond that distinct
keys meet it by a shuffle. Confirmed keys that many URLs have are few, and are broadcast; others are
joined by a shuffle, so no key is hot there.

Null URLs and those without "://" have an empty host and path and fit nothing. Repeated rows are
judged each; extra columns are kept if asked for, under their own names. Entries that are listed twice
count once, by priority, allow before block; entries with a null or empty host are no entries, a null
path is empty. An empty list allows all; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import scratch, stored

#: Bits of the filter for each entry; words of 32 bits in a block, with one bit of a key in each.
BITS_PER_KEY, WORDS = 16, 8
#: The filter is broadcast up to so many blocks (8 MB of bits).
BROADCAST_BLOCKS = 250_000
#: A key that more than one of so many candidate keys is, is hot; there are no more hot keys than that.
HOT_SHARE = 2000
#: Odd numbers under 2^31, one for each word: the top bits of a product with the hash choose the word's bit.
SALTS = (0x2545F491, 0x5851F42D, 0x14057B7F, 0x7F4A7C15, 0x3C6EF373, 0x6C8E9CF5, 0x1B873593, 0x4CF5AD43)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, in lower case; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def entries(listed: DataFrame) -> DataFrame:
    """host, path, priority, verdict and key of a list, each key once."""
    priority = F.coalesce(F.col("priority").cast("int"), F.lit(0)) if "priority" in listed.columns else F.lit(0)
    rows = listed.select(F.translate(F.col("host").cast("string"), UPPER, LOWER).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), (-priority).alias("last"), F.col("verdict").cast("string").alias("verdict"))
    first = rows.filter("host <> ''").groupBy("host", "path").agg(F.min(F.struct("last", "verdict")).alias("first"))
    return first.select("host", "path", (-F.col("first.last")).alias("priority"), "first.verdict", key(F.col("host"), F.col("path")).alias("key"))


def key(host: Column, path: Column) -> Column:
    """Host and path in one text, parted by a line feed, which no listed host holds."""
    return F.concat(host, F.lit("\n"), path)


def hashed(key_: Column, n_blocks: int) -> tuple[Column, Column]:
    """The block of a key, and 32 bits that choose its bits."""
    h = F.xxhash64(key_)
    return F.pmod(F.shiftright(h, 32), F.lit(n_blocks)).cast("long"), h.bitwiseAND(F.lit(0xFFFFFFFF))


def bit(low: Column, word: int) -> Column:
    """The one bit of a key in a word, as a long."""
    place = F.shiftright((low * F.lit(SALTS[word])).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """block and its words w0 ..., from rows of `key`; blocks without keys have no row."""
    block, low = hashed(F.col("key"), n_blocks)
    rows = keys.select(block.alias("block"), low.alias("low"))
    return rows.groupBy("block").agg(*[F.bit_or(bit(F.col("low"), k)).alias(f"w{k}") for k in range(WORDS)])


def possible(rows: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """rows (with `key`) that the filter doesn't rule out."""
    block, low = hashed(F.col("key"), n_blocks)
    met = rows.withColumns({"block_": block, "low_": low}).join(blocks, F.col("block_") == F.col("block"))
    held = [F.col(f"w{k}").bitwiseAND(bit(F.col("low_"), k)) != 0 for k in range(WORDS)]
    every = held[0]
    for one in held[1:]:
        every = every & one
    return met.filter(every).select(*rows.columns)


def candidates(urls: DataFrame, shapes: tuple[list[int], list[int]]) -> DataFrame:
    """row, key and rank (greater decides) of the keys that entries of these numbers of labels and lengths of path could have."""
    labels, lengths = (F.array(*map(F.lit, sorted(x))).cast("array<int>") for x in shapes)
    rows = urls.select("row", "host", "path", F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("m")).filter("host <> ''")
    rows = rows.withColumn("k", F.explode(F.filter(labels, lambda k: k <= F.col("n")))).withColumn("p", F.explode(F.filter(lengths, lambda p: p <= F.col("m"))))
    tail = F.expr("substring_index(host, '.', -k)")
    return rows.select("row", key(tail, F.expr("left(path, p)")).alias("key"), F.struct(F.length(tail).alias("host"), F.col("p").alias("path")).alias("rank"))


def filter_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url", keep: list[str] | None = None, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """The columns `keep` (default: all) of pages, host, path, entry_host, entry_path, priority (null without a fitting entry) and verdict.

    A column of pages with one of the new names gives way to it.
    """
    new = ("host", "path", "entry_host", "entry_path", "priority", "verdict")
    kept = [c for c in (pages.columns if keep is None else keep) if c not in new]
    url = pages[url_col].cast("string")
    with scratch() as store:
        rows = pages.select(F.struct(*[pages[c] for c in kept]).alias("given"), url_host(url).alias("host"), url_path(url).alias("path"), F.monotonically_increasing_id().alias("row"))
        rows = store(rows, "urls")  # so that a row's number is the same whenever it is read
        entry = store(entries(listed), "entries")
        n_entries, lengths, labels = entry.agg(F.count(F.lit(1)), F.collect_set(F.length("path")), F.collect_set(F.size(F.split("host", r"\.")))).first()
        keys = candidates(rows, (labels, lengths))
        n_blocks = max(1, -(-n_entries * bits_per_key // (32 * WORDS)))
        blocks = store(bloom_blocks(entry, n_blocks), "blocks")
        if n_blocks <= BROADCAST_BLOCKS:
            near = possible(keys, F.broadcast(blocks), n_blocks).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        else:  # each key once before it moves
            near = possible(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")), blocks, n_blocks)
        sure = store(near.join(entry, "key").select(F.col("key").alias("key_"), "host", "path", "priority", "verdict", "n"), "sure")
        total = sure.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        hot = F.col("n") * HOT_SHARE > total
        decided = sure.withColumn("entry", F.struct("host", "path", "priority", "verdict")).select("key_", "entry", "n")
        few = keys.join(F.broadcast(decided.filter(hot)), F.col("key") == F.col("key_"))
        many = keys.join(decided.filter(~hot), F.col("key") == F.col("key_"))
        best = few.unionByName(many).groupBy(F.col("row").alias("row_")).agg(F.max_by("entry", F.struct("entry.priority", "rank")).alias("entry"))
        out = rows.join(best, F.col("row") == F.col("row_"), "left")
        out = out.select(*[F.col("given")[c].alias(c) for c in kept], "host", "path", F.col("entry.host").alias("entry_host"), F.col("entry.path").alias("entry_path"), F.col("entry.priority").alias("priority"), F.coalesce("entry.verdict", F.lit("allow")).alias("verdict"))
        return stored(out, "judged")
