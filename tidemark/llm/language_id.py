"""Language identification by interpolated Kneser-Ney character models.

Fitting: per language, a documented sample of labelled texts (the ``SAMPLE`` smallest hashes of doc_id; of a text of more
than ``SAMPLE_CHARS`` characters, ``SAMPLE_PIECES`` pieces of together as many) gives counts of character n-grams up to ``ORDER``, added up by Spark. The highest order uses
counts, lower ones the number of distinct characters before an n-gram, all with one absolute discount per order. The
models of all languages share sorted arrays of n-gram hashes, one row of log probabilities a hash; what a language has
not seen is filled with its back-off probability, so one look-up a character does for all languages. What none has seen
takes the weights of its context, from sorted arrays of their own, and the next lower order. Their size is bounded by the sample, and they are broadcast.

Reading: letters are lower-cased, everything else is a word boundary. Every text is scored whole, in pieces of bounded
size. The language with the lowest cross-entropy per character wins. A text is rejected where that cross-entropy lies
``REJECT_SPREADS`` spreads above the median of the language's own sample; the spread is the distance between the
median and the 90th percentile there, and no smaller than 0.15 of the median. Short texts stray further: ``SHORT`` bits,
divided by the square root of the number of characters, are allowed on top.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import U64, chunks, mixed, signed, with_own_id, with_plain_id

ORDER = 4
SAMPLE = 600
SAMPLE_CHARS = 20_000
SAMPLE_PIECES = 4
REJECT_SPREADS = 6.0
SHORT = 8.0  # bits; divided by the square root of a text's length
PIECE = 1 << 18  # characters scored at once
NONE = "und"
_INDEX_BITS = 18
_EDGE = 32
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def reading(text: str | None) -> np.ndarray:
    """Lower-case letters of a text with one boundary wherever something else stands; empty if there is no letter.

    It starts with ``ORDER - 1`` boundaries, which are given, not predicted.
    """
    if not isinstance(text, str) or not text:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return np.empty(0, np.uint32)
    codes = np.where(letter, codes, _EDGE).astype(np.uint32)
    keep = letter | np.r_[True, letter[:-1]]
    codes = codes[keep]
    start, end = codes[int(codes[0] == _EDGE) :], [_EDGE] if codes[-1] != _EDGE else []
    return np.concatenate([np.full(ORDER - 1, _EDGE), start, end]).astype(np.uint32)


def grams(codes: np.ndarray, order: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``order`` characters up to each position (from ``order - 1`` on, if none are given)."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, U64)
    wide = codes.astype(U64)
    out = np.full(n if ends is None else len(ends), order, U64)
    for i in range(order):
        out *= U64(0x9E3779B97F4A7C15)
        out += wide[i : n + i] if ends is None else wide[ends - (order - 1 - i)]
    return mixed(out)


@dataclass
class Table:
    """Sorted hashes with a start index over their highest bits, and log probabilities by language."""

    hashes: np.ndarray
    values: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, values: np.ndarray) -> Table:
        starts = np.searchsorted(hashes, np.arange(1 << _INDEX_BITS, dtype=U64) << U64(64 - _INDEX_BITS))
        return cls(np.append(hashes, U64(2**64 - 1)), values.astype(np.float64), starts.astype(np.int32))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        at = self.starts[(wanted >> U64(64 - _INDEX_BITS)).astype(np.int64)]
        last = len(self.hashes) - 1
        behind = np.flatnonzero(self.hashes[at] < wanted)
        while len(behind):
            at[behind] += 1
            behind = behind[(self.hashes[at[behind]] < wanted[behind]) & (at[behind] < last)]
        return np.where((self.hashes[at] == wanted) & (at < last), at, -1)


@dataclass
class Model:
    languages: list[str]
    tables: list[Table]  # by order, from 1
    backoff: list[Table]  # by order: weights of the contexts, for n-grams that no language has seen
    floor: np.ndarray  # log probability of a character that no language's model has
    limits: np.ndarray  # cross-entropy per language from which a text is rejected

    def total(self, codes: np.ndarray) -> np.ndarray:
        """Sum of log2 probabilities of a reading by language."""
        out = np.zeros(len(self.languages))
        for at in range(0, len(codes) - ORDER + 1, PIECE):
            piece = codes[at : at + PIECE + ORDER - 1]
            ends = None
            for order in range(ORDER, 0, -1):
                rows = self.tables[order - 1].find(grams(piece, order, ends))
                missed = np.flatnonzero(rows < 0)
                hit = np.delete(rows, missed) if len(missed) else rows
                out += np.ones(len(hit)) @ self.tables[order - 1].values[hit]
                if not len(missed):
                    break
                ends = missed + ORDER - 1 if ends is None else ends[missed]
                if order > 1:
                    rows = self.backoff[order - 1].find(grams(piece, order - 1, ends - 1))
                    out += self.backoff[order - 1].values[rows[rows >= 0]].sum(axis=0)
            else:
                out += len(missed) * self.floor
        return out

    def decide(self, text: str | None) -> tuple[str, float, bool, float]:
        """(language, score, rejected, bits per character)."""
        codes = reading(text)
        if not len(codes) or not self.languages:
            return NONE, 0.0, True, 0.0
        count = len(codes) - ORDER + 1
        entropy = -self.total(codes) / count
        best = int(np.argmin(entropy))
        # posterior of the best language over at most fifty characters, so that long texts keep graded scores
        odds = np.exp2(-(entropy - entropy[best]) * min(count, 50))
        return self.languages[best], float(1 / odds.sum()), bool(entropy[best] > self.limits[best] + SHORT / count**0.5), float(entropy[best])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learned_from(text: str) -> F.Column:
    """A text, or of a long one a piece from a hash-chosen place in each of ``SAMPLE_PIECES`` equal stretches."""
    size, stretch = SAMPLE_CHARS // SAMPLE_PIECES, F.floor(F.length(text) / SAMPLE_PIECES)
    pieces = []
    for i in range(SAMPLE_PIECES):
        start = stretch * i + F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(stretch - size + 1, F.lit(1)))
        pieces.append(F.substring(F.col(text), (start + 1).cast("int"), F.lit(size)))
    return F.when(F.length(text) <= SAMPLE_CHARS, F.col(text)).otherwise(F.concat_ws(" ", *pieces))


def sample(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The labelled texts to learn from: at most ``size`` a language, those of the smallest doc_id hashes.

    A bound on the hash, from each language's number of ids, leaves a few times as many rows before they are ranked, so
    what meets in one task does not grow with the corpus.
    """
    usable = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    ids = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()  # one row a language
    bounds = F.create_map(*[F.lit(x) for r in ids for x in (r["lang"], 4.0 * size / max(1, r["n"]))]) if ids else None
    near = usable.select("lang", place.alias("place"), F.xxhash64("text").alias("key"), _learned_from("text").alias("text"))
    near = near.where(F.col("place") <= F.element_at(bounds, F.col("lang"))) if ids else near
    first = Window.partitionBy("lang").orderBy("place", "key")
    return near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= size).select("lang", "text")


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in chunks(frames, 100):
        out = []
        for lang, texts in frame.groupby("lang")["text"]:
            readings = [r for r in map(reading, texts) if len(r)]
            if not readings:
                continue
            for order in range(1, ORDER + 1):
                # hashes of an n-gram, of it without its last and of it without its first character
                ends = [np.arange(ORDER - 1, len(r)) for r in readings]
                full, head, tail = (
                    np.concatenate([grams(r, size, e - back) if size else np.zeros(len(e), U64)
                                    for r, e in zip(readings, ends, strict=True)])
                    for size, back in ((order, 0), (order - 1, 1), (order - 1, 0)))
                values, at, n = np.unique(full, return_index=True, return_counts=True)
                out.append(pd.DataFrame({"lang": lang, "n": order, "gram": signed(values),
                                         "head": signed(head[at]), "tail": signed(tail[at]),
                                         "count": n}))
        if out:
            yield pd.concat(out)


def _kneser_ney(counts: dict[int, pd.DataFrame], alphabet: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], dict]:
    """Per order: sorted hashes with interpolated probabilities; and each context's back-off weight."""
    orders, backoff = [], {}
    lower = None
    for order in range(1, ORDER + 1):
        own = counts[order]
        if order < ORDER:  # continuation counts: in how many longer n-grams this one is the end
            longer = counts[order + 1]
            tails, n = np.unique(longer["tail"].to_numpy().view(U64), return_counts=True)
            hashes = own["gram"].to_numpy().view(U64)
            at = np.minimum(np.searchsorted(tails, hashes), len(tails) - 1)
            c = np.where(tails[at] == hashes, n[at], 1).astype(float) if len(tails) else np.ones(len(hashes))
        else:
            c = own["count"].to_numpy().astype(float)
        once, twice = (c == 1).sum(), (c == 2).sum()
        discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        contexts, inverse = np.unique(own["head"].to_numpy().view(U64), return_inverse=True)
        totals = np.bincount(inverse, c)
        weight = discount * np.bincount(inverse) / totals
        if lower is None:
            below = np.full(len(c), 1 / (alphabet + 1))
        else:
            tail = own["tail"].to_numpy().view(U64)
            below = lower[1][np.searchsorted(lower[0], tail)]
        p = np.maximum(c - discount, 0) / totals[inverse] + weight[inverse] * below
        hashes = own["gram"].to_numpy().view(U64)
        by = np.argsort(hashes)
        lower = hashes[by], p[by]
        orders.append(lower)
        backoff[order] = contexts, weight
    return orders, backoff


def fit(docs: DataFrame, size: int = SAMPLE) -> Model:
    """Models of all languages with labelled texts. The driver gets n-gram counts of the bounded sample only."""
    texts = sample(docs, size).cache()
    counted = (
        texts.mapInPandas(_counted, "lang string, n int, gram long, head long, tail long, count long")
        .groupBy("lang", "n", "gram").agg(F.first("head").alias("head"), F.first("tail").alias("tail"), F.sum("count").alias("count"))
        .toPandas().sort_values(["lang", "n", "gram"])
    )
    languages = sorted(counted["lang"].unique())
    alphabet = counted[counted["n"] == 1]["gram"].nunique()
    fitted = {}
    for lang in languages:
        rows = counted[counted["lang"] == lang]
        fitted[lang] = _kneser_ney({n: rows[rows["n"] == n] for n in range(1, ORDER + 1)}, alphabet)
    tables: list[Table] = []
    backoff_tables: list[Table] = []
    floor = np.full(len(languages), 0.0)
    for j, lang in enumerate(languages):
        floor[j] = np.log2(fitted[lang][1][1][1][0] / (alphabet + 1)) if len(fitted[lang][1][1][1]) else -30.0
    for order in range(1, ORDER + 1):
        every = counted[counted["n"] == order].drop_duplicates("gram")
        hashes = every["gram"].to_numpy().view(U64)
        by = np.argsort(hashes)
        hashes, head, tail = hashes[by], every["head"].to_numpy().view(U64)[by], every["tail"].to_numpy().view(U64)[by]
        values = np.empty((len(hashes), len(languages)))
        for j, lang in enumerate(languages):
            orders, backoff = fitted[lang]
            contexts, weight = backoff[order]
            own, p = orders[order - 1]
            place = np.minimum(np.searchsorted(contexts, head), max(0, len(contexts) - 1))
            known = contexts[place] == head if len(contexts) else np.zeros(len(head), bool)
            factor = np.where(known, np.log2(weight[place]), 0.0) if len(contexts) else np.zeros(len(head))
            if order == 1:
                below = np.full(len(hashes), -np.log2(alphabet + 1))
            else:
                below = tables[-1].values[tables[-1].find(tail), j]
            values[:, j] = factor + below
            at = np.minimum(np.searchsorted(own, hashes), max(0, len(own) - 1))
            mine = own[at] == hashes if len(own) else np.zeros(len(hashes), bool)
            values[mine, j] = np.log2(p[at[mine]])
        tables.append(Table.of(hashes, values))
        every_context = np.unique(np.concatenate([fitted[lang][1][order][0] for lang in languages] or [np.empty(0, U64)]))
        weights = np.zeros((len(every_context), len(languages)))
        for j, lang in enumerate(languages):
            contexts, weight = fitted[lang][1][order]
            weights[np.searchsorted(every_context, contexts), j] = np.log2(weight)
        backoff_tables.append(Table.of(every_context, weights))
    model = Model(languages, tables, backoff_tables, floor, np.full(len(languages), np.inf))
    if languages:
        _calibrate(model, texts)
    texts.unpersist()
    return model


def _calibrate(model: Model, texts: DataFrame) -> None:
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [shared.value.decide(t) for t in frame["text"]]
            yield pd.DataFrame({"lang": frame["lang"].array, "found": [f[0] for f in found], "bits": [f[3] for f in found]})

    right = texts.mapInPandas(own, "lang string, found string, bits double").where("lang = found").groupBy("lang").agg(
        F.percentile("bits", F.lit(0.5)).alias("mid"), F.percentile("bits", F.lit(0.9)).alias("high"))
    for row in right.collect():  # one row a language
        spread = max(row["high"] - row["mid"], 0.15 * row["mid"])
        model.limits[model.languages.index(row["lang"])] = row["mid"] + REJECT_SPREADS * spread


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``, ``rejected``.

    ``lang_pred`` is a learned language, ``und`` for a text that is null or has no letter (score 0, rejected), and for
    every text if there was nothing to learn from. ``score`` is the winner's posterior against the other languages.
    Only the text decides; rows that repeat get equal answers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def decide(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.decide(t)[:3] for t in texts], columns=["lang_pred", "score", "rejected"])

    kept = docs.drop("lang_pred", "score", "rejected")
    return kept.withColumn("_found", decide("text")).select(*kept.columns, "_found.*")
