"""The public engine: compiled rules, a key, and redact / detect / restore on DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..scratch import stored
from ..sources.rules import RuleList, default_rules
from . import dictionary, restore as restoring, spans
from .byte_segments import safe_byte_segments

#: Texts that stand in so many rows on average are worked out once each and joined to their rows.
REPEATED = 8


class PiiEngine:
    """overlap: "greedy" drops what overlaps a better hit, "split" keeps the parts that are left; None as the reference chooses.

    recognizers: functions from a column of safe segments (off, seg) to candidates, such as
    ner.segment_recognizer() makes; their candidates come after those of the rule lists.
    """

    def __init__(self, key: bytes, rules: Sequence[RuleList] | None = None, keywords: Sequence[tuple[str, str]] = (), excludes: Sequence[str] = (), prefix: str = dictionary.PREFIX, overlap: str | None = None, recognizers: Sequence[Callable[[Column], Column]] = ()):
        self.key, self.rules = key, list([default_rules()] if rules is None else rules)
        self.keywords, self.excludes, self.prefix = list(dict(keywords).items()), list(excludes), prefix
        self.recognizers = list(recognizers)
        self.overlap = overlap or ("greedy" if self.rules or self.recognizers else "split")

    def detect(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with `hits`: disjoint candidates with placeholders, in the order of start. Texts may be BINARY: bytes that aren't UTF-8 end a segment."""
        # segments and candidates are columns of their own, so each is worked out once
        cut = safe_byte_segments if isinstance(docs.schema[text_col].dataType, T.BinaryType) else spans.safe_segments
        rows = docs.withColumn("segments_", cut(docs[text_col]))
        found = spans.detect("segments_", self.rules, self.keywords)
        if self.recognizers:
            found = F.concat(found, *[F.coalesce(spans.beside("segments_", r), spans.no_candidates()) for r in self.recognizers])
        rows = rows.withColumn("hits", spans.exclude(found, self.excludes)).drop("segments_")
        chosen = spans.greedy(F.col("hits")) if self.overlap == "greedy" else spans.split_resolution(F.col("hits"), F.col(text_col))
        rows = rows.withColumn("hits", chosen)
        named = F.transform("hits", lambda c: c.withField("placeholder", dictionary.placeholder(self.key, c["category"], c["original"], self.prefix)))
        return rows.withColumn("hits", named)

    def redact(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """detect(), and `redacted`. Each row by itself: each hit has its own category's placeholder.

        Neither first registrations nor numbers for equal placeholders are taken into account, which
        need other rows: redact_with_mapping() does that.
        """
        rows = self.detect(docs, text_col)
        made = spans.replace_spans(F.col(text_col).cast("string"), F.col("hits"))  # a cast keeps bytes as they are
        return rows.withColumn("redacted", made.cast(docs.schema[text_col].dataType))

    def redact_with_mapping(self, docs: DataFrame, order_col: str, text_col: str = "text", created_at: Column | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """redact(), and the mapping; an original has one placeholder everywhere, that of its first hit or the one it has in `known`.

        Rows are detected once and kept in the shared folder. One shuffle on originals for the mapping;
        rows with hits meet their spans again by their text, so ids may be null or repeated, and rows
        without hits never move. Where texts repeat much, each is redacted once, at its first row in
        the order, and rows meet theirs by their text.
        """
        if repeat(docs, text_col):
            at = F.col(order_col), created_at if created_at is not None else F.current_timestamp()
            once = docs.groupBy(F.col(text_col).alias("text")).agg(F.min(F.struct(at[0].alias("ord"), at[1].alias("at"))).alias("first")).select("text", "first.ord", "first.at")
            once, mapping = self._redact_rows(once, "ord", "text", F.col("at"), known)
            return by_text(docs, text_col, once, "hits", "redacted"), mapping
        return self._redact_rows(docs, order_col, text_col, created_at, known)

    def _redact_rows(self, docs: DataFrame, order_col: str, text_col: str, created_at: Column | None, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = stored(self.detect(docs, text_col), "detected")
        made = created_at if created_at is not None else F.current_timestamp()
        each = exploded(rows.select(F.col(order_col).alias("doc_ord"), made.alias("created_at"), "hits"), "hits").select("doc_ord", "created_at", "h.start", "h.category", "h.original")
        mapping = dictionary.build_mapping(each, self.key, self.prefix)
        if known is not None:
            mapping = dictionary.register(known, mapping)
        mapping = stored(mapping, "mapping")
        some = rows.filter(F.size("hits") > 0).withColumn("text_key_", text_key(F.col(text_col)))
        # texts alike have the same hits
        places = exploded(some.select("text_key_", "hits"), "hits").select("text_key_", "h.start", "h.end", "h.original").distinct()
        placed = places.join(mapping.select("original", "placeholder"), "original")
        spans_ = placed.groupBy("text_key_").agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("spans_"))
        changed = some.join(spans_, "text_key_", "left").withColumn("redacted", spans.replace_spans(F.col(text_col), F.col("spans_")))
        same = rows.filter(F.coalesce(F.size("hits"), F.lit(0)) <= 0).withColumn("redacted", F.col(text_col))
        return changed.select(*rows.columns, "redacted").unionByName(same), mapping

    def restore(self, docs: DataFrame, mapping: DataFrame, text_col: str) -> DataFrame:
        return restoring.restore(docs, mapping, text_col, self.prefix)


def text_key(text: Column) -> Column:
    """Texts alike, and only they, have one key."""
    return F.sha2(text.cast("binary"), 256)


def repeat(docs: DataFrame, text_col: str) -> bool:
    """Whether texts stand in REPEATED rows each, on average."""
    n = docs.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64(docs[text_col])).alias("texts")).first()
    return n.rows >= REPEATED * max(n.texts, 1)


def by_text(docs: DataFrame, text_col: str, once: DataFrame, *made: str) -> DataFrame:
    """docs with the columns that once (one row for each text) has made of `text`; null is a text."""
    once = stored(once.select(F.col("text").alias("text_met_"), *[F.col(c).alias(f"{c}_met_") for c in made]), "once")
    met = docs.join(once, docs[text_col].eqNullSafe(once["text_met_"]), "left")
    return met.select(*[docs[c] for c in docs.columns if c not in made], *[F.col(f"{c}_met_").alias(c) for c in made])


def exploded(rows: DataFrame, column: str) -> DataFrame:
    """rows without the array column and with its elements as `h`; the array isn't asked for its size below, which would work it out again."""
    return rows.select(*[c for c in rows.columns if c != column], F.explode_outer(column).alias("h")).filter("h is not null")
