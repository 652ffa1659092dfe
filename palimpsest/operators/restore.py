"""Putting originals back where their placeholders stand."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import stored
from .dictionary import PREFIX
from .spans import by_cluster, let, pieces_with_offsets, replace_spans

# Fixed value: what follows the prefix of a placeholder.
BODY = r"[A-Za-z0-9_]+_[a-f0-9]{12}(?:_\d+)?(?:__)?"
TOKENS = "array<struct<start:int,end:int,token:string>>"


def patterns(prefix: str = PREFIX) -> list[str]:
    """Of placeholders, and of those that lost the underscores before their prefix."""
    bare = prefix.lstrip("_")
    return [re.escape(prefix) + BODY] + ([rf"(?<!_){re.escape(bare)}{BODY}"] if bare != prefix and bare else [])


def found_tokens(text: Column, pattern: str) -> Column:
    """array<struct<start, end, token>>: offsets from the lengths of what stands between."""
    found = F.regexp_extract_all(text, F.lit(f"(?d){pattern}"), F.lit(0))
    before = lambda f: pieces_with_offsets(F.split(text, f"(?d){pattern}", -1), F.transform(f, F.octet_length))
    at = lambda p: p["off"] + F.octet_length(p["seg"])
    token = lambda p, t: F.struct(at(p).alias("start"), (at(p) + F.octet_length(t)).alias("end"), t.alias("token"))
    # both are bound once: inside the function of each token they would be worked out for each
    return let(found, lambda f: let(before(f), lambda b: F.transform(f, lambda t, i: token(F.get(b, i), t))))


def normal_token(token: Column, prefix: str = PREFIX) -> Column:
    lead = prefix[: len(prefix) - len(prefix.lstrip("_"))]
    full = F.when(token.startswith(prefix), token).otherwise(F.concat(F.lit(lead), token))
    return F.when(full.endswith("__"), full).otherwise(F.concat(full, F.lit("__")))


def tokens(text: Column, prefix: str = PREFIX) -> Column:
    """array<struct<start, end, token>> of all placeholders in text, tokens in their normal form."""
    found = F.concat(*[found_tokens(text, p) for p in patterns(prefix)])
    found = F.transform(found, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), normal_token(t["token"], prefix).alias("token")))
    return F.when(F.contains(text, F.lit(prefix.lstrip("_") or prefix)), found).otherwise(F.array().cast(TOKENS))


def restore(docs: DataFrame, mapping: DataFrame, text_col: str, prefix: str = PREFIX) -> DataFrame:
    """docs with `restored` and n_restored.

    Placeholders meet the mapping in an equi-join and come back by their text, so rows need no id and
    may repeat; rows without a placeholder take no part and never move. Rows are kept in the shared
    folder: they are read several times, and a filter on tokens would work out again whatever makes
    the text. Where texts repeat much, each is restored once.
    """
    from .engine import by_text, repeat

    kept = [c for c in docs.columns if c not in ("restored", "n_restored")]
    rows = stored(docs.select(*[docs[c] for c in kept], docs[text_col].alias("text_in_hand_")), "to_restore")
    if repeat(rows, "text_in_hand_"):
        once = restored_rows(rows.select(F.col("text_in_hand_").alias("text")).distinct(), mapping, "text", prefix)
        return by_text(rows, "text_in_hand_", once, "restored", "n_restored").drop("text_in_hand_")
    return restored_rows(rows, mapping, "text_in_hand_", prefix).drop("text_in_hand_")


def restored_rows(docs: DataFrame, mapping: DataFrame, text_col: str, prefix: str) -> DataFrame:
    from .engine import exploded, text_key

    kept = docs.columns
    rows = stored(docs.withColumn("tokens_found_", tokens(F.col(text_col), prefix)), "tokens")
    some = F.coalesce(F.size("tokens_found_") > 0, F.lit(False))
    with_tokens = rows.filter(some).withColumn("text_key_", text_key(F.col(text_col)))
    each = exploded(with_tokens.select("text_key_", "tokens_found_"), "tokens_found_").select("text_key_", "h.start", "h.end", "h.token").distinct()
    known = each.join(mapping.select(F.col("placeholder").alias("token"), "original"), "token")
    free = "array<struct<start:int,end:int,original:string>>"
    spans = known.groupBy("text_key_").agg(F.array_sort(F.collect_list(F.struct("start", "end", "original"))).alias("known_spans_"))
    first = lambda some: F.aggregate(some, F.array().cast(free), lambda acc, x: F.when(F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) <= x["start"], F.concat(acc, F.array(x))).otherwise(acc))
    disjoint = by_cluster(F.col("known_spans_"), first)
    out = with_tokens.join(spans, "text_key_", "left").withColumn("known_spans_", F.coalesce(disjoint, F.array().cast(free)))
    out = out.select(*kept, replace_spans(F.col(text_col), F.col("known_spans_"), "original").alias("restored"), F.size("known_spans_").cast("long").alias("n_restored"))
    return out.unionByName(rows.filter(~some).select(*kept, F.col(text_col).alias("restored"), F.lit(0).cast("long").alias("n_restored")))
