"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A target of c times the source's size gives every
document floor(c) certain whole copies; the rest of the target is a sample without replacement.
Inclusion probabilities follow the square root of a document's size, so that the words expected are
the rest; documents whose probability would be 1 or more are certain, and what they leave is dealt
again to the others until none exceeds 1. The others are ranked by random odds over inclusion odds,
u / (1 - u) : p / (1 - p), and the smallest ranks are taken until the words left are used up; the
last one is taken if that comes nearer. One rule holds for documents of any size. Random numbers come
from MD5 of seed and doc_id, so reruns agree.

The target is missed by half of the last document at most. No source is ordered in one task: sizes
are summed by weight to find what is certain, ranks are cut into classes, the classes' sums find the
one where the target is met, and only that one is ordered. What is known of a source ends as a least
weight that is certain and a largest rank, which every row is held against.

Null text has size 0. Null sources are one source, weighed last. Rows of one source that share
doc_id and size share a rank and are taken together. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

WEIGHTS = (5, 2, 1)
TOTAL, CAP, CLASSES, SEED = 1.5, 2.0, 4096, 17
#: A table of sources is broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_SOURCES = 100_000
NO_WEIGHT = (1 << 63) - 1
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, total: float = TOTAL, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds target to one row for each source: total x all sizes by weight, none above cap x its size, the excess dealt again.

    A share depends on all sources, so these rows, one for each source, meet in one task.
    """
    by_name, whole = W.orderBy(F.col("source").asc_nulls_last()), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    # sources reach their cap in this order: at each, what one unit of weight gets if all before it are full
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumns({
        "full": F.coalesce(F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "open_weight": F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)),
        "words": F.sum("source_size").over(whole),
    })
    s = s.withColumn("share", (F.lit(total) * F.col("words") - F.lit(cap) * F.col("full")) / F.col("open_weight"))
    s = s.withColumn("is_full", F.col("share") * F.col("weight") >= F.lit(cap) * F.col("source_size"))
    level = F.max(F.when(~F.col("is_full"), F.col("share"))).over(whole)
    target = F.when(F.col("is_full"), F.lit(cap) * F.col("source_size")).otherwise(level * F.col("weight"))
    return s.withColumn("target", target).select(*sizes.columns, "target")


def uniform(key: Column, seed: int) -> Column:
    """52 bits of MD5, strictly between 0 and 1."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def size_weight(size: Column) -> Column:
    return F.greatest(F.floor(F.sqrt(size)), F.lit(1)).cast("long")


def ranked(rows: DataFrame) -> DataFrame:
    """Adds weight and rank, from a source's figures, to rows of documents that aren't certain."""
    p = F.try_divide(F.col("left") * size_weight(F.col("size")), F.col("weighed"))
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return rows.withColumn("p", p).withColumn("rank", (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))


def open_rows(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Ranked rows that chance decides on."""
    return ranked(beside(rows, sources)).filter((F.col("part") > 0) & (F.col("size") > 0) & (size_weight(F.col("size")) < F.col("certain_weight")))


def beside(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with their source's figures; sources is a stored table, so its rows can be counted first."""
    small = sources.withColumnRenamed("source", "source_")
    small = F.broadcast(small) if sources.count() <= BROADCAST_SOURCES else small
    return rows.join(small, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> dict[str, Column]:
    return {"source": docs[source_col].cast("string"), "size": F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORD)), F.lit(0)).cast("long"), "u": uniform(docs[id_col], seed)}


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, total: float = TOTAL, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """Stored tables: doc_id, source, size, u of each document; and each source's figures with its least certain weight and its largest rank that is taken."""
    rows = stored(docs.select(docs[id_col].alias("doc_id"), *[c.alias(k) for k, c in sized(docs, id_col, text_col, source_col, seed).items()]), "sizes")
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), total, cap, weights)
    sources = sources.withColumn("copies", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    sources = sources.withColumn("part", F.coalesce(F.try_divide("target", "source_size") - F.col("copies"), F.lit(0.0)))
    sources = stored(sources.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "sources")

    # a source has as many weights as the square root of its largest size at most; the largest weights are certain first
    sums = rows.filter("size > 0").groupBy("source", size_weight(F.col("size")).alias("weight")).agg(F.sum("size").alias("words"))
    down = W.partitionBy("source").orderBy(F.col("weight").desc())
    sums = beside(sums, sources.select("source", "rest", "part")).withColumns({
        "above": F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "below": F.sum(F.col("words") * F.col("weight")).over(down.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })
    sums = sums.withColumn("sure", (F.col("part") > 0) & ((F.col("rest") - F.col("above")) * F.col("weight") >= F.col("below")))
    found = sums.groupBy("source").agg(F.min(F.when(F.col("sure"), F.col("weight"))).alias("certain_weight"), F.sum(F.when(F.col("sure"), F.col("words")).otherwise(0)).alias("certain_words"), F.sum(F.when(~F.col("sure"), F.col("words") * F.col("weight")).otherwise(0)).alias("weighed"))
    sources = with_figures(sources, found).withColumns({"certain_weight": F.coalesce("certain_weight", F.lit(NO_WEIGHT)), "weighed": F.coalesce("weighed", F.lit(0)), "left": F.col("rest") - F.coalesce("certain_words", F.lit(0))})
    sources = stored(sources.drop("certain_words"), "sources")

    # the others by class of rank
    classes = open_rows(rows, sources).withColumn("class", rank_class()).groupBy("source", "class").agg(F.sum("size").alias("words"), F.max("left").alias("left"))
    classes = classes.withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy("class")) - F.col("words")).filter("before <= left")
    last = classes.groupBy("source").agg(F.max_by(F.struct("class", "before"), "class").alias("last")).select("source", F.col("last.class").alias("last_class"), F.col("last.before").alias("before"))
    sources = stored(with_figures(sources, last).withColumn("last_class", F.coalesce("last_class", F.lit(-1))), "sources")
    edge = open_rows(rows, sources).filter(rank_class() == F.col("last_class"))
    by_rank = W.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = edge.withColumn("before", F.col("before") + F.sum("size").over(by_rank) - F.col("size"))
    edge = edge.filter("before + size / 2 <= left").groupBy("source").agg(F.max("rank").alias("rank_in_class"))
    return rows, stored(with_figures(sources, edge).withColumn("rank_in_class", F.coalesce("rank_in_class", F.lit(-1.0))), "sources")


def with_figures(sources: DataFrame, more: DataFrame) -> DataFrame:
    return sources.join(more.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")


def rank_class() -> Column:
    return F.floor(F.col("rank") / (1 + F.col("rank")) * CLASSES).cast("int")


def copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds size-based figures and n_copies to rows that have source, size and u; row by row, with a source's figures beside."""
    r = ranked(beside(rows, sources))
    by_rank = (rank_class() < F.col("last_class")) | ((rank_class() == F.col("last_class")) & (F.col("rank") <= F.col("rank_in_class")))
    taken = (F.col("part") > 0) & (F.col("size") > 0) & ((size_weight(F.col("size")) >= F.col("certain_weight")) | by_rank)
    return r.withColumn("n_copies", F.col("copies") + F.coalesce(F.when(taken, 1), F.lit(0)))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and n_copies of each document."""
    rows, sources = mixing_plan(docs, **options)
    return copies(rows, sources).select("doc_id", "source", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"), "n_copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """docs with each row as often as the mix takes it; texts aren't shuffled."""
    _, sources = mixing_plan(docs, id_col, text_col, source_col, seed, **options)
    whole, figures = F.struct(*[docs[c] for c in docs.columns]).alias("row_in_hand"), sized(docs, id_col, text_col, source_col, seed)
    rows = copies(docs.select(whole, *[c.alias(k) for k, c in figures.items()]), sources).filter("n_copies > 0")
    return rows.select("row_in_hand", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).select("row_in_hand.*")
