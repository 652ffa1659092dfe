"""Whole requests and WebSocket messages: gate, decoding, route, redaction, revert and the audit row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import audit
from .engine import PiiEngine
from .jsonprompt import redact_json, with_validity
from .requests import gate


def redact_requests(engine: PiiEngine, requests: DataFrame, mode: str = "global", targets: list[str] = (), json_prompts: bool = True) -> DataFrame:
    """requests with note, attempted, decoded, out_body (as text), redacted_count, matches (as audit shows them) and redacted.

    Bodies of JSON requests are redacted in their prompts, others and unreadable JSON as a whole.
    JSON that redaction broke goes on as it came, with the note invalid_json and its hits still counted.
    Bodies that the gate stops go on untouched. json_prompts=False redacts every body as a whole.
    """
    rows = gate(requests, mode, targets)
    json_type = F.coalesce(F.col("content_type"), F.lit("")).contains("application/json")
    rows = rows.withColumns({"text_": F.when(F.col("attempted"), F.col("decoded").cast("string")), "json_type_": json_type})
    rows = redact_json(engine, rows, "text_", F.col("json_type_") & F.lit(json_prompts))
    # JSON that isn't JSON any more; then what came in goes on
    told = F.col("attempted") & F.col("json_type_") & (F.col("n_hits") > 0)
    rows = rows.withColumns({"before_": F.when(told, F.col("text_")), "after_": F.when(told, F.col("redacted_body"))})
    rows = with_validity(rows, {"before_": "was_json_", "after_": "stays_json_"})
    rows = rows.withColumn("broken_", told & F.col("was_json_") & ~F.col("stays_json_"))
    done = F.col("attempted") & (F.col("n_hits") > 0) & ~F.coalesce("broken_", F.lit(False))
    rows = rows.withColumns({
        "out_body": F.when(done, F.col("redacted_body")).when(F.col("attempted"), F.col("text_")).otherwise(F.col("body").cast("string")),
        "note": F.when(F.col("broken_"), "invalid_json").otherwise(F.col("note")), "redacted_count": F.coalesce("n_hits", F.lit(0)).cast("long"),
        "matches": audit.shown_matches(F.col("hits")), "redacted": F.coalesce(done, F.lit(False)),
    })
    return rows.drop("text_", "json_type_", "broken_", "before_", "after_", "was_json_", "stays_json_", "is_json", "redacted_body", "n_hits", "hits")


def redact_messages(engine: PiiEngine, messages: DataFrame) -> DataFrame:
    """Messages as audit.reassembled() gives them, with `redacted`: text on its way up, JSON in its prompts only; any other stays."""
    rows = redact_json(engine, messages.withColumn("change_", F.col("is_text") & (F.col("dir") == "up")), "payload", F.col("change_"))
    return rows.withColumn("redacted", F.when(F.col("change_"), F.col("redacted_body")).otherwise(F.col("payload"))).drop("change_", "is_json", "redacted_body", "hits", "n_hits")
