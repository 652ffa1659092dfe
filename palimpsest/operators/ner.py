"""Named entities from a model that the caller brings; what it finds becomes candidates."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, functions as F

from ..sources.rules import NER_PRIORITY

DEFAULT_ENTITIES = ("PERSON", "ORG", "LOCATION")
FOUND = "array<struct<start:int,end:int,entity:string,score:double>>"


def category(entity: Column) -> Column:
    return F.when(entity.isin("ORGANIZATION", "ORG"), "ORG").when(entity.isin("GPE", "LOC", "LOCATION"), "LOCATION").otherwise(entity)


def analyze_url(url: Column) -> Column:
    """Without query and fragment, with /analyze once; null if it isn't http(s)."""
    base = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"(?:/analyze)?/*$", "")
    return F.when(F.lower(url).rlike(r"^https?://[^/]"), F.concat(base, F.lit("/analyze")))


def recognizer(analyze: Callable[[list[str]], list[list[tuple[int, int, str, float]]]]):
    """A UDF from texts to FOUND, in characters; if the model fails, nothing is found, and the task's log says why."""

    @F.pandas_udf(FOUND)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(analyzed(analyze, [t or "" for t in texts]))

    return run


def analyzed(analyze: Callable, texts: list[str], timeout: float | None = None, **options) -> list:
    """What a model finds in each text; nothing if it fails or takes longer than `timeout` seconds."""
    try:
        if timeout is None:
            return list(analyze(texts, **options))
        pool = ThreadPoolExecutor(1)
        try:
            return list(pool.submit(analyze, texts, **options).result(timeout))
        finally:
            pool.shutdown(wait=False)
    except Exception:  # noqa: BLE001  fails open: a lost model must not stop requests
        logging.getLogger("palimpsest.ner").warning("the model failed on %d texts; nothing is found in them", len(texts), exc_info=True)
        return [[] for _ in texts]


def request_options(language: str = "", least_score: float = 0.0) -> dict:
    """What a request says beside the text: the language (en if it isn't set or auto), and a least score above 0."""
    name = re.sub(r"[-_ ]+", "-", re.sub(r"[^a-z0-9\-_ ]", "", language.strip().lower())).strip("-")
    return {"language": "en" if name in ("", "auto") else name} | ({"score_threshold": min(1.0, least_score)} if least_score > 0 else {})


def segment_recognizer(analyze: Callable[..., list[list[tuple[int, int, str, float]]]], entities: tuple[str, ...] = DEFAULT_ENTITIES, language: str = "", least_score: float = 0.0, rule_ord: int = 10_000, timeout: float | None = None) -> Callable[[Column], Column]:
    """For PiiEngine(recognizers=...): from safe segments to candidates. analyze(texts, language=..., score_threshold=...) gets all segments of a batch at once, and has `timeout` seconds for them."""
    wanted, options = set(entities), request_options(language, least_score)
    names = {"ORGANIZATION": "ORG", "GPE": "LOCATION", "LOC": "LOCATION"}

    def run(segments: pd.Series) -> pd.Series:
        flat = [s for segs in segments if segs is not None for s in segs]
        made = iter(analyzed(analyze, [s["seg"] for s in flat], timeout, **options) if flat else [])

        def of(s) -> list:
            text, out = s["seg"], []
            raw = text.encode()
            for start, end, entity, score in next(made):
                name = names.get(entity, entity)
                if name not in wanted or score < least_score or not 0 <= start < end <= len(raw):
                    continue
                if end <= len(text):  # characters; ends beyond them are taken for bytes
                    start, end = len(text[:start].encode()), len(text[:end].encode())
                out.append((s["off"] + start, s["off"] + end, name, NER_PRIORITY, "ner", rule_ord, raw[start:end].decode("utf-8", "replace")))
            return out

        return pd.Series([[c for s in segs for c in of(s)] if segs is not None else [] for segs in segments], index=segments.index)

    # a schema in words can only be read when there is a session
    return lambda segments: F.pandas_udf(run, "array<struct<start:int,end:int,category:string,priority:int,source:string,rule_ord:int,original:string>>")(segments)


def gazetteer(names: dict[str, str]):
    """A stand-in for a model: whole words by list, name to entity."""
    return recognizer(word_list(names))


def word_list(names: dict[str, str]) -> Callable:
    """What gazetteer() asks, for recognizers of segments."""
    pattern = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + r")\b")
    return lambda texts, **_: [[(m.start(), m.end(), names[m[0]], 0.85) for m in pattern.finditer(t)] for t in texts]


def candidates(text: Column, found: Column, entities: tuple[str, ...] = DEFAULT_ENTITIES, least_score: float = 0.0, rule_ord: int = 10_000) -> Column:
    """Candidates with byte offsets. Ends beyond the text's characters but within its bytes are taken for bytes."""
    from .spans import NONE

    kept = F.filter(found, lambda f: category(f["entity"]).isin(*entities) & (f["score"] >= least_score) & (f["start"] >= 0) & (f["start"] < f["end"]) & (f["end"] <= F.octet_length(text)))
    in_bytes = lambda f: f["end"] > F.length(text)
    at = lambda f, k: F.when(in_bytes(f), f[k]).otherwise(F.octet_length(F.substring(text, F.lit(1), f[k])))
    original = lambda f: F.decode(F.substring(text.cast("binary"), at(f, "start") + 1, at(f, "end") - at(f, "start")), "UTF-8")
    made = F.transform(kept, lambda f: F.struct(at(f, "start").alias("start"), at(f, "end").alias("end"), category(f["entity"]).alias("category"), F.lit(NER_PRIORITY).alias("priority"), F.lit("ner").alias("source"), F.lit(rule_ord).alias("rule_ord"), original(f).alias("original")))
    return made.cast(NONE)
