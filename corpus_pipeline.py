"""A corpus pipeline of five operators: language, near duplicates, benchmark passages, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run()
writes each stage's rows to the shared folder as Parquet and reads them as the next one's docs. All
stages but the last return the columns of documents.

Rows with a null doc_id are kept by the near-duplicate stage: they can't be named in links. Of rows
that share the smallest doc_id of a group all stay. Every stage takes an empty table, and extra
columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm import decontamination, jaccard_join, language_id, mixing, token_orc
from palimpsest.llm.common import deleted, scratch_path, stored
from palimpsest.llm.queries import byte_bpe, table


#: Pieces whose ids a worker remembers: fewer than a job of its own would, as the stages before hold memory too.
REMEMBERED = 20_000


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no operator makes, and these by the columns' own."""
    names = {c: f"given_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt; those without letters or in no such language go."""
    given, names = renamed(docs)
    model = language_id.learn_languages(language_id.learning_rows(given, names["doc_id"], names["text"], names["lang"]))
    return back(language_id.identify_language(given, model, names["text"]).filter(~language_id.rejected()), names)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id."""
    groups = jaccard_join.jaccard_components(docs)
    gone = stored(groups.filter("doc_id != component_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    few = gone.count() <= jaccard_join.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["id"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make less than the share that contaminates."""
    given, names = renamed(docs)
    return back(decontamination.mark_contamination(given, table(spark, sf_dir, "benchmark"), names["text"]).filter("not contaminated"), names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files; what the files hold of each row."""
    path = scratch_path(spark, "tokens")
    token_orc.write_tokens(docs, path, byte_bpe(), remembered=REMEMBERED)
    return token_orc.token_digests(spark, path)


STAGES = [
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", write_token_files),
]
#: Suffix automata and Pareto ranks are not for SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        if before:  # its only reader is done
            deleted(spark, before)
        before = docs.stored_at
    return docs
