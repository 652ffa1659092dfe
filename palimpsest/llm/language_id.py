"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut greedily into the
longest phrases that the automaton knows; the number of phrases, over what the language's own text
needs for as many letters, is its normalised count, and the language with the smallest wins.

Whole texts are parsed, and a result doesn't depend on how. A text is laid out in lanes of LANE symbols
that numpy steps through together, each going on into the next one for OVERLAP symbols. What follows
the begin of a phrase doesn't depend on what was before it, so where a lane and the next one begin a
phrase at one place they agree from there on, and the count goes over to the next lane. Where two
lanes don't meet so soon, a plain parse goes on from the first until it meets another. Every letter that
was learnt is a symbol of its own; transitions are kept in one table of those that exist, whose size
follows the learnt letters and not the alphabets.

Learning takes a bounded sample: SAMPLE_DOCUMENTS documents of each language, or SAMPLE_ALL over the
number of languages if that is less (2 at least), of LONGEST characters at most; of their symbols
LEARN_LETTERS, or LEARN_ALL over the number of languages, make the automaton, and the others the
language's own rate. Every language is learnt, whatever their number.

Texts without a letter, null and empty ones are `und` with score 0. With nothing to learn from, all
are. Ties go to the first label by code point. Repeated rows are judged alike; empty tables give none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import LongTable, append_columns, stored

#: Bounds of the learning sample: documents of a language and of all, characters (fewer are preferred), symbols of a language and of all.
SAMPLE_DOCUMENTS, SAMPLE_ALL, SAMPLE_CHARS, LONGEST, LEARN_LETTERS, LEARN_ALL = 48, 12_000, 8000, 40_000, 12_000, 1_200_000
LANE, OVERLAP = 512, 64
#: Languages that are stepped through together.
ABREAST = 8
#: Symbols of texts that are parsed together.
TOGETHER = 1_500_000
#: Bits of a symbol in a transition's key.
SYMBOL_BITS = 21
UNKNOWN = "und"
BLANK, OTHER, FIRST = 0, 1, 2
#: A text of so many letters that needs more than so many times its language's own phrases is in none of the languages.
REJECT_LETTERS, REJECT_RATE = 100, 2.0
LETTER = np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and c not in go[at]:
            go[at][c] = new
            at = link[at]
        if at >= 0:
            to = go[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(go)
                go.append(dict(go[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and go[at].get(c) == to:
                    go[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return go


@dataclass
class LanguageModel:
    languages: list[str]
    classes: np.ndarray
    transitions: LongTable
    to: np.ndarray
    starts: np.ndarray
    rates: np.ndarray

    def symbols(self, text: str) -> np.ndarray:
        """Classes of letters, runs of others as one blank."""
        c = self.classes[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        return c[(c != BLANK) | np.concatenate([[False], c[:-1] != BLANK])] if len(c) else c

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The state after each symbol, -1 if there is none."""
        found = self.transitions.find(states << SYMBOL_BITS | symbols)
        return np.where(found < 0, -1, self.to[found])

    def own_phrases(self, language: int, texts: list[np.ndarray]) -> int:
        """How many phrases texts need by one language."""
        alone = LanguageModel([self.languages[language]], self.classes, self.transitions, self.to, self.starts[language:language + 1], self.rates)
        return int(alone.phrases(texts).sum())

    @cached_property
    def edges(self) -> dict[int, int]:
        """All transitions by key."""
        at = np.flatnonzero(self.transitions.keys >= 0)
        return dict(zip(self.transitions.keys[at].tolist(), self.to[self.transitions.places[at]].tolist()))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """How many phrases each text (rows) needs by each language (columns)."""
        found = np.zeros((len(texts), len(self.languages)), np.int64)
        if sum(map(len, texts)):
            for a in range(0, len(self.languages), ABREAST):
                start = self.starts[a:a + ABREAST]
                found[:, a:a + len(start)] = self.in_lanes(texts, start)
        return found

    def in_lanes(self, texts: list[np.ndarray], start: np.ndarray) -> np.ndarray:
        """Phrases of each text by the automata that begin at `start`."""
        k, size = len(start), np.fromiter(map(len, texts), np.int64, len(texts))
        lanes = -(-size // LANE)
        n, flat = int(lanes.sum()), np.concatenate(texts)
        owner = np.repeat(np.arange(len(texts)), lanes)
        place = np.arange(n) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = (np.cumsum(size) - size)[owner] + place * LANE
        own, length = (np.minimum(x, size[owner] - place * LANE) for x in (LANE, LANE + OVERLAP))
        # longest lanes first: those still open are a prefix
        order = np.argsort(-length, kind="stable")
        first, shorter = at[order], -length[order]
        state, begins = np.repeat(start[:, None], n, 1), np.zeros((LANE + OVERLAP, k, n), bool)
        for t in range(-int(shorter[0])):
            live = int(np.searchsorted(shorter, -t))
            now, symbol, begin = state[:, :live].ravel(), np.tile(flat[first[:live] + t].astype(np.int64), k), np.repeat(start, live)
            then = self.step(now, symbol)
            fresh = then < 0
            again = np.flatnonzero(fresh & (now != begin))
            then[again] = self.step(begin[again], symbol[again])
            # at the start any phrase begins; a symbol that the language hasn't is a phrase
            begins[t, :, :live] = (fresh | (now == begin)).reshape(k, live)
            state[:, :live] = np.where(then < 0, begin, then).reshape(k, live)
        begins = begins[:, :, np.argsort(order)]
        inside, beyond = begins[:LANE], begins[LANE:]
        joins, over = np.zeros((k, n), np.int64), np.zeros((k, n), np.int64)  # where the parse comes to a lane; phrases of the lane before that begin in it until then
        nexts = np.flatnonzero(place > 0)
        if len(nexts):
            common = beyond[:, :, nexts - 1] & inside[:OVERLAP][:, :, nexts]
            met, joins[:, nexts] = common.any(0), common.argmax(0)
            over[:, nexts] = (beyond[:, :, nexts - 1] & (np.arange(OVERLAP)[:, None, None] < joins[None][:, :, nexts])).sum(0)
            for j, i in zip(*np.nonzero(~met)):
                self.go_on(j, int(nexts[i]), start, flat, at, own, owner, inside, joins, over)
        kept = (inside & (np.arange(LANE)[:, None, None] >= joins[None])).sum(0) + over
        return np.stack([np.bincount(owner, kept[j], len(texts)) for j in range(k)], 1).astype(np.int64)

    def go_on(self, j: int, lane: int, start: np.ndarray, flat: np.ndarray, at: np.ndarray, own: np.ndarray, owner: np.ndarray, inside: np.ndarray, joins: np.ndarray, over: np.ndarray) -> None:
        """Parses on from the lane before `lane` until a phrase begins where one of a later lane does; lanes in between have no part."""
        before = lane - 1
        if joins[j, before] >= own[before]:  # passed over by an earlier one, which has settled this lane
            return
        edges, begin = self.edges, int(start[j])
        p, end = int(at[before] + np.flatnonzero(inside[:, j, before])[-1]), int(at[lane] + own[lane])
        over[j, lane], now, symbols = 0, begin, None
        last = int(np.searchsorted(owner, owner[lane], "right"))
        stop, q = int(at[last - 1] + own[last - 1]), p
        joins[j, lane] = own[lane]
        while q < stop:
            if symbols is None or q >= base + len(symbols):
                base, symbols = q, flat[q:q + LANE].tolist()
            c = symbols[q - base]
            then = edges.get(now << SYMBOL_BITS | c, -1)
            if then < 0 or now == begin:
                if q > p:  # a phrase begins here
                    while q >= end:
                        lane += 1
                        end = int(at[lane] + own[lane])
                        joins[j, lane], over[j, lane] = own[lane], 0
                    if inside[q - int(at[lane]), j, lane]:
                        joins[j, lane] = q - int(at[lane])
                        return
                    over[j, lane] += 1
                if then < 0:
                    then = edges.get(begin << SYMBOL_BITS | c, -1)
            now = begin if then < 0 else then
            q += 1
        for lane in range(lane + 1, last):
            joins[j, lane], over[j, lane] = own[lane], 0


def learn_languages(rows: list[tuple[str, str]]) -> LanguageModel:
    """From (language, text) pairs."""
    by: dict[str, list[str]] = {}
    for language, text in sorted(set(rows)):
        by.setdefault(language, []).append(text.lower())
    letters = sorted({c for texts in by.values() for t in texts for c in set(t) if c.isalpha()})
    classes = np.where(LETTER, OTHER, BLANK).astype(np.int32)
    classes[[ord(c) for c in letters]] = np.arange(FIRST, FIRST + len(letters))
    model = LanguageModel([], classes, LongTable(np.zeros(0, np.int64)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    most, states, keys, to, starts, lent = min(LEARN_LETTERS, max(64, LEARN_ALL // max(1, len(by)))), 0, [], [], [], {}
    for language, texts in by.items():
        # pieces of many documents; every fourth text is kept for the language's own rate
        own = [model.symbols(t) for t in texts]
        learn = [s for k, s in enumerate(own) if k % 4 or len(own) < 2]
        each = max(64, most // max(1, len(learn)))
        sample = np.concatenate([np.append(s[:each], BLANK) for s in learn])[:most]
        if (sample >= OTHER).any():
            go = suffix_automaton(sample.tolist())
            keys += [states + s << SYMBOL_BITS | c for s, edges in enumerate(go) for c in edges]
            to += [states + x for edges in go for x in edges.values()]
            starts.append(states)
            states += len(go)
            model.languages.append(language)
            lent[language] = [s for k, s in enumerate(own) if not k % 4 or len(own) < 2]
    model.transitions, model.to, model.starts = LongTable(np.array(keys, np.int64)), np.array(to, np.int64), np.array(starts, np.int64)
    model.rates = np.array([max(1e-3, model.own_phrases(k, lent[x]) / max(1, sum(map(len, lent[x])))) for k, x in enumerate(model.languages)])
    return model


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id as text, by `of`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def learning_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """SAMPLE_DOCUMENTS texts of each language at most, of documents that may be learnt from: by hash, those of up to SAMPLE_CHARS first."""
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("x"), docs[lang_col].cast("string").alias("l"))
    rows = rows.filter((remainder(F.col("i"), 5) != 0) & F.col("l").isNotNull() & (F.length("x") <= LONGEST) & F.col("x").rlike(r"\p{L}"))
    hashed = F.xxhash64(F.lit(5), "i")
    order = F.struct(F.length("x").between(200, SAMPLE_CHARS).cast("int") * -1, hashed.alias("h"), F.col("i").alias("i"))
    picked = stored(rows.groupBy("l", F.pmod(hashed, F.lit(SAMPLE_DOCUMENTS)).alias("b")).agg(F.min(order).alias("o")), "picked")
    # with many languages, fewer documents of each
    most = max(2, SAMPLE_ALL // max(1, picked.select("l").distinct().count()))
    if most < SAMPLE_DOCUMENTS:
        picked = picked.withColumn("k", F.row_number().over(W.partitionBy("l").orderBy("o"))).filter(F.col("k") <= most)
    ids = [(r.l, r.i) for r in picked.select("l", "o.i").collect()]
    if not ids:
        return []
    wanted = docs.sparkSession.createDataFrame(ids, "wl string, wi " + rows.schema["i"].dataType.simpleString())
    # at most SAMPLE_ALL rows, or two for each language
    found = rows.join(F.broadcast(wanted), (F.col("i") == F.col("wi")) & (F.col("l") == F.col("wl"))).groupBy("l", "i").agg(F.min("x").alias("x"))
    return [(r.l, r.x) for r in found.collect()]


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of docs, lang_pred, score, letters and rate (phrases over those of the language's own text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("letters", T.LongType()), T.StructField("rate", T.DoubleType())]

    def compute(texts: list[bytes | None]) -> list[pa.Array]:
        m = shared.value
        letters, size, found = np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64), np.zeros((len(texts), len(m.languages)), np.int64)
        held, first = [], 0
        for k, t in enumerate(texts):  # parsed in parts, so that memory doesn't follow the batch
            held.append(m.symbols(t.decode("utf-8", "replace") if t else ""))
            letters[k], size[k] = (held[-1] != BLANK).sum(), max(1, len(held[-1]))
            if size[first:k + 1].sum() >= TOGETHER or k + 1 == len(texts):
                found[first:k + 1] = m.phrases(held)
                held, first = [], k + 1
        if not m.languages:
            return [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts))), pa.array(letters), pa.array(np.zeros(len(texts)))]
        rate = found / size[:, None] / m.rates
        best = rate.argmin(1)
        lead = (rate - rate.min(1, keepdims=True)) * np.sqrt(size)[:, None]
        score = 1 / np.exp(-lead).sum(1)
        known = letters > 0
        return [pa.array([m.languages[b] if k else UNKNOWN for b, k in zip(best, known)]), pa.array(np.where(known, score, 0.0)), pa.array(letters), pa.array(rate.min(1))]

    return append_columns(docs, text_col, fields, compute, keep)


def rejected() -> Column:
    """Of identify_language()'s rows: no letters, or in none of the languages."""
    return (F.col("lang_pred") == UNKNOWN) | ((F.col("letters") >= REJECT_LETTERS) & (F.col("rate") > REJECT_RATE))
