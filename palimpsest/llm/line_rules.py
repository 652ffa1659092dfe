"""Quality rules with cross-document line frequency, in DataFrame functions alone.

Lines are normalised (ASCII lower case, white space trimmed and collapsed) and hashed. For each
host, the documents that hold a line are counted; lines in more than a limit of them are removed,
and a document that keeps less than half of its distinct lines' words is rejected. Base rules need
no other document.

Each row is a document: repeated rows count each. Null text has no words; a null host is a host of
its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

BLANKS = " \t\n\x0b\f\r"
#: A line is removed if more documents of a host hold it.
MAX_DOCUMENTS = 20
#: A document that keeps a smaller share of its distinct lines' words is rejected.
LEAST_KEPT = 0.5
LEAST_WORDS, REPEATED_SHARE = 50, 50
#: Lines above the limit are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 100_000
#: Bits of a window's place beside its hash.
PLACE_BITS = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def repeated_words(profile: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with words: words in three-word windows that occur twice or more.

    Hash and place of a window share a long, so sorting longs brings equal windows together, and
    neighbours with one hash are held against each other word by word. Texts where such neighbours
    differ, and those with too many words for a place, sort hashes with the words themselves instead,
    so the figure is exact whatever hashes do.
    """
    word = lambda i: F.get("words", i)
    window = lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))
    places = F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)
    low = (1 << PLACE_BITS) - 1
    fits = (F.col("n_words") <= low) & (F.col("n_words") > 3)
    packed = F.when(fits, F.sort_array(F.transform(places, lambda i: window(i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))).otherwise(F.array().cast("array<bigint>"))
    same = lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)
    rows = profile.withColumn("packed", packed)
    short = F.filter("packed", lambda p, k: same(F.coalesce(F.get("packed", k - 1), F.bitwise_not(p)), p) | same(F.coalesce(F.get("packed", k + 1), F.bitwise_not(p)), p))
    rows = rows.withColumn("alike", short)
    place = lambda p: p.bitwiseAND(F.lit(low)).cast("int")
    differ = lambda i, j: (word(i) != word(j)) | (word(i + 1) != word(j + 1)) | (word(i + 2) != word(j + 2))
    after = lambda p, k: F.coalesce(F.get("alike", k + 1), F.bitwise_not(p))
    mixed = F.size(F.filter("alike", lambda p, k: same(after(p, k), p) & differ(place(p), place(after(p, k))))) > 0
    rows = rows.withColumn("by_words", (F.col("n_words") > low) | mixed)
    spelt = F.sort_array(F.transform(places, lambda i: F.struct(window(i).alias("h"), word(i).alias("a"), word(i + 1).alias("b"), word(i + 2).alias("c"), i.cast("long").alias("i"))))
    rows = rows.withColumn("spelt", F.when(F.col("by_words"), spelt).otherwise(F.array().cast("array<struct<h:bigint,a:string,b:string,c:string,i:bigint>>")))
    equal = lambda x, p: F.coalesce((x["h"] == p["h"]) & (x["a"] == p["a"]) & (x["b"] == p["b"]) & (x["c"] == p["c"]), F.lit(False))
    long = F.filter("spelt", lambda p, k: equal(F.get("spelt", k - 1), p) | equal(F.get("spelt", k + 1), p))
    starts = F.when(F.col("by_words"), F.transform(long, lambda p: p["i"])).otherwise(F.transform("alike", lambda p: p.bitwiseAND(F.lit(low))))
    rows = rows.withColumn("starts", F.sort_array(starts))
    first = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("starts", first, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("n")), lambda acc: acc["n"])
    return rows.withColumn("n_repeat_words", covered).drop("packed", "alike", "by_words", "spelt", "starts")


def text_profile(docs: DataFrame, text_col: str, host_col: str, id_col: str) -> DataFrame:
    """Each row's own figures, and its distinct normalised lines as (hash, words)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[host_col].cast("string").alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({"words": split_words(F.col("text")), "own_lines": lines})
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    rows = repeated_words(rows)
    normal = lambda x: F.regexp_replace(F.btrim(x, F.lit(BLANKS)), r"[\x20\x09-\x0D]+", " ")
    # lower() would also fold other alphabets; that only makes more lines alike; strings are told apart by a hash set, structs one by one
    different = F.array_distinct(F.transform("own_lines", lambda x: F.lower(normal(x))))
    hashed = F.transform(different, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.regexp_count(x, F.lit(" ")) + 1).alias("words")))
    return rows.select(
        "doc_id", "host", F.xxhash64("text").alias("text_hash"), "n_words", F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("own_lines") - F.size(F.array_distinct("own_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words", hashed.alias("lines"),
    )


def line_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id", max_documents: int = MAX_DOCUMENTS, least_kept: float = LEAST_KEPT) -> DataFrame:
    """doc_id, the base figures, base_failed, line_words, removed_words and kept."""
    profile = stored(text_profile(docs, text_col, host_col, id_col), "profile")
    lines = profile.select("doc_id", "host", "text_hash", F.explode("lines").alias("x")).select("doc_id", "host", "text_hash", "x.line", "x.words")
    frequent = stored(lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_documents).select(F.col("host").alias("host_"), F.col("line").alias("line_")), "lines")
    frequent = F.broadcast(frequent) if frequent.count() <= BROADCAST_ROWS else frequent
    removed = lines.join(frequent, (F.col("line") == F.col("line_")) & F.col("host").eqNullSafe(F.col("host_")), "left_semi")
    # rows alike in all three have the same lines, so their mean is what each of them loses
    removed = removed.groupBy(F.col("doc_id").alias("i"), F.col("host").alias("h"), F.col("text_hash").alias("t"), "line").agg(F.max("words").alias("words"))
    removed = removed.groupBy("i", "h", "t").agg(F.sum("words").alias("removed_words"))
    rows = profile.join(removed, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("host").eqNullSafe(F.col("h")) & (F.col("text_hash") == F.col("t")), "left")
    rows = rows.withColumns({
        "removed_words": F.coalesce("removed_words", F.lit(0)).cast("long"),
        "line_words": F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["words"]),
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_SHARE * F.col("n_words")),
    })
    kept = ~F.col("base_failed") & (F.col("line_words") - F.col("removed_words") >= F.lit(least_kept) * F.col("line_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_words", "removed_words", kept.alias("kept"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT r, i, words[i:i + 2] AS win FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
own AS (SELECT r, doc_id, source, line FROM (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM own GROUP BY r),
norm AS (SELECT DISTINCT r, source, array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' ') AS line FROM own),
freq AS (SELECT source, line FROM norm GROUP BY source, line HAVING count(*) > {MAX_DOCUMENTS}),
loss AS (SELECT n.r, sum(len(string_split(n.line, ' '))) AS line_words, sum(CASE WHEN f.line IS NOT NULL THEN len(string_split(n.line, ' ')) ELSE 0 END) AS removed_words
  FROM norm n LEFT JOIN freq f ON n.line = f.line AND n.source IS NOT DISTINCT FROM f.source GROUP BY n.r),
s AS (SELECT d.doc_id, len(w.words)::BIGINT AS n_words, coalesce(length(array_to_string(w.words, '')), 0)::BIGINT AS word_chars, len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(cov.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(loss.line_words, 0)::BIGINT AS line_words, coalesce(loss.removed_words, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN loss USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_words, removed_words,
  NOT base_failed AND line_words - removed_words >= {LEAST_KEPT} * line_words AS kept
FROM (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_SHARE} * n_words AS base_failed FROM s)
"""
