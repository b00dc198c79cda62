"""LM scoring with a log-frequency Bloom filter of bigram counts.

Counting: every task gathers a block of training tokens, counts its distinct words and bigrams, and sends each segment of
the hash space what falls into it, as packed arrays; a segment's task adds the blocks up. The number of segments follows
the size of the corpus, so a segment stays bounded, and a word that makes up a third of all tokens is one entry a block.
Word counts stay exact (64-bit hashes). All bigrams go into the filter, those seen once too.

Filter: a bigram with count c is inserted once per half octave from 1 up to c, each time under another key, so a count is
read by probing level after level until one is missing. Every segment has a filter of its own, of ``BITS_PER_ITEM`` bits
an insertion: the filters grow with the corpus in number, not in size, and are never brought together.

Scoring: p(word | previous) = w * min(1, c2 / c1) + (1 - w) * p(word), with w = ``WEIGHT``, c2 the filter's lower bound of
the bigram count, c1 the exact count of the previous word and p(word) the add-half estimate. Documents are dealt into
blocks; a block asks the segments for the exact counts of its distinct words and for the levels at which their filters
hold its distinct bigrams, and is scored with the answers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, WordHashes, mixed, pin, with_own_id, with_plain_id

WEIGHT = 0.4
MAX_BITS = 1 << 28
BITS_PER_ITEM = 10
PROBES = 4
LEAST = 2  # smallest count of a capped filter; scores() starts at 1
BLOCK_TOKENS = 1_000_000
SEGMENT_TOKENS = 3_000_000
END, START = U64(1), U64(2)  # the end of a text, and what stands before its first word
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_LEVELS = 128
_PACKED = "kind string, segment int, grams binary, counts binary"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def token_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The words of a text in lower case (A-Z only) and its end."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    return np.append(hashes.of(raw.translate(_LOWER).split()), END)


def bigram_hashes(tokens: np.ndarray, previous: np.ndarray) -> np.ndarray:
    """48-bit hashes."""
    return mixed(previous * U64(0x9E3779B97F4A7C15) + tokens) >> U64(16)


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """The bigrams of whole texts that stand one after the other, each closed by its end."""
    before = np.roll(tokens, 1)
    return bigram_hashes(tokens, np.where(before == END, START, before))


def segment_of(grams: np.ndarray, segments: int, bits: int) -> np.ndarray:
    """Equal stretches of the hash space, in its order."""
    return ((grams >> U64(bits - 32)) * U64(segments)) >> U64(32)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Sorted numbers byte by byte: the high bytes repeat and compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(planes: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(planes, np.uint8).reshape(width, -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, :width] = rows.T
    return out.view("<u8").ravel()


def _slices(grams: np.ndarray, segments: int, bits: int) -> Iterator[tuple[int, slice]]:
    """The part of a sorted array that falls into each segment."""
    owner = segment_of(grams, segments, bits)
    for segment in np.unique(owner).tolist():
        yield segment, slice(*np.searchsorted(owner, [segment, segment + 1]))


_KINDS = {"word": (64, 8), "bigram": (48, 6)}


def _counted(segments: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held, size = WordHashes(), [], 0

        def flush():
            tokens = np.concatenate(held)
            out = []
            for kind, values in (("word", tokens), ("bigram", _pairs(tokens))):
                bits, width = _KINDS[kind]
                grams, counts = np.unique(values, return_counts=True)
                out += [(kind, segment, _planes(grams[part], width), _planes(counts[part], 4))
                        for segment, part in _slices(grams, segments, bits)]
            return pd.DataFrame(out, columns=["kind", "segment", "grams", "counts"])

        for frame in frames:
            for text in frame["text"]:
                held.append(token_hashes(text, hashes))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    """The blocks' counts of one segment together: those of words as they are, those of bigrams as the segment's filter."""
    kind = frame["kind"].iloc[0]
    width = _KINDS[kind][1]
    grams, place = np.unique(np.concatenate([_numbers(g, width) for g in frame["grams"]]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([_numbers(c, 4) for c in frame["counts"]])).astype(np.int64)
    end = int(counts[grams == END].sum()) if kind == "word" else 0
    if kind == "word":
        held = grams.tobytes(), counts.tobytes()
    else:
        held = _filter_bits(grams, level_of(counts, 1), _size(int((level_of(counts, 1) + 1).sum()))), b""
    return pd.DataFrame({"kind": [kind], "segment": [frame["segment"].iloc[0]], "grams": [held[0]], "counts": [held[1]],
                         "n": [len(grams)], "total": [int(counts.sum())], "ends": [end]})


def level_of(counts: np.ndarray, cutoff: float) -> np.ndarray:
    """Half octaves above the cutoff."""
    return np.floor(2 * np.log2(np.maximum(counts, 1) / cutoff) + 1e-9).astype(np.int64)


@dataclass
class Filter:
    """Bits of all segments, one stretch after the other."""

    bits: np.ndarray
    per_segment: int
    segments: int
    cutoff: float

    @staticmethod
    def place(grams: np.ndarray, level: int, probe: int, size: int) -> np.ndarray:
        x = mixed(grams + U64((level + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        return ((x & U64(0xFFFFFFFF)) + U64(probe) * ((x >> U64(32)) | U64(1))) % U64(size)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The highest level at which each is held; -1 for what is not held."""
        level = np.full(len(grams), -1, np.int64)
        at = np.arange(len(grams)) if self.per_segment else np.empty(0, np.int64)
        for step in range(_LEVELS):
            base = segment_of(grams[at], self.segments, 48) * U64(self.per_segment)
            for i in range(PROBES):
                if not len(at):
                    break
                place = base + self.place(grams[at], step, i, self.per_segment)
                set_ = (self.bits[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1 > 0
                at, base = at[set_], base[set_]
            if not len(at):
                break
            level[at] = step
        return level

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Lower bounds of the counts; 0 for what is not held."""
        return _lower_bounds(self.levels(grams), self.cutoff)


def _lower_bounds(level: np.ndarray, cutoff: float) -> np.ndarray:
    return np.where(level < 0, 0.0, cutoff * np.exp2(level / 2))


def _size(items: int, segments: int = 1) -> int:
    """Bits of one segment's filter, in whole bytes."""
    return math.ceil(items * BITS_PER_ITEM / segments / 8) * 8


def _filter_bits(grams: np.ndarray, top: np.ndarray, size: int) -> bytes:
    """A filter of ``size`` bits that holds every gram from level 0 to its top; none of a negative top."""
    flags = np.zeros(size, bool)
    for level in range(int(top.max(initial=-1)) + 1):
        grams, top = grams[top >= level], top[top >= level]
        for probe in range(PROBES):
            flags[Filter.place(grams, level, probe, size).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _filled(size: int, cutoff: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for segment, packed, n in zip(frame["segment"], frame["grams"], frame["counts"], strict=True):
                grams, counts = np.frombuffer(packed, U64), np.frombuffer(n, np.int64)
                top = np.where(counts >= cutoff, level_of(counts, cutoff), -1)
                yield pd.DataFrame({"segment": [segment], "bits": [_filter_bits(grams, top, size)]})

    return run


def bloom_filter(bigrams: DataFrame, segments: int, max_bits: int = MAX_BITS) -> Filter:
    """One filter of bounded size over added-up bigrams; the driver gets its bits and one count a level.

    Where more than ``max_bits`` are needed, the cutoff rises by half octaves (2, 3, 4, 6, 8, ...), and bigrams below it are
    lost. ``scores`` does without: its segments keep filters of their own.
    """
    stood = {r["pos"]: r["n"] for r in bigrams.select(F.posexplode("levels")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
    for raised in range(_LEVELS):
        items = sum(n * (level - raised + 1) for level, n in stood.items() if level >= raised)
        if items * BITS_PER_ITEM <= max_bits:
            break
    cutoff = LEAST * 2 ** (raised / 2)
    size = _size(items, segments)
    if not size:
        return Filter(np.zeros(0, np.uint8), 0, segments, cutoff)
    bits = np.zeros(size // 8 * segments, np.uint8)
    for row in bigrams.select("segment", "grams", "counts").mapInPandas(
            _filled(size, cutoff), "segment int, bits binary").toLocalIterator():
        bits[row[0] * size // 8 : (row[0] + 1) * size // 8] = np.frombuffer(row[1], np.uint8)
    return Filter(bits, size, segments, cutoff)


def _distinct(texts: pd.Series) -> tuple[np.ndarray, list[int]]:
    hashes = WordHashes()
    tokens = [token_hashes(t, hashes) for t in texts]
    return np.concatenate(tokens), [len(t) for t in tokens]


def _sorted_distinct(values: np.ndarray) -> np.ndarray:
    """``np.unique`` of a non-empty array; that hashes, which takes many times longer than a sort."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def _asks(segments: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tokens, block = _distinct(frame["text"])[0], int(frame["block"].iloc[0])
        out = []
        for kind, values in (("word", tokens), ("bigram", _pairs(tokens))):
            bits, width = _KINDS[kind]
            grams = _sorted_distinct(values)
            out += [(block, kind, segment, _planes(grams[part], width)) for segment, part in _slices(grams, segments, bits)]
        return pd.DataFrame(out, columns=["block", "kind", "segment", "grams"])

    return run


def _answers(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """For words their counts, for bigrams the level above which the filter does not hold them plus one (0: not held)."""
    grams, counts = (known[n].iloc[0] if len(known) else b"" for n in ("grams", "counts"))
    out = []
    for block, kind, segment, packed in asked[["block", "kind", "segment", "grams"]].itertuples(index=False):
        wanted = _numbers(packed, _KINDS[kind][1])
        if kind == "bigram":
            held = Filter(np.frombuffer(grams, np.uint8), len(grams) * 8, 1, 1)
            out.append((block, kind, segment, (held.levels(wanted) + 1).astype(np.uint8).tobytes()))
            continue
        words, found = np.frombuffer(grams, U64), np.zeros(len(wanted), np.int64)
        if len(words):
            at = np.minimum(np.searchsorted(words, wanted), len(words) - 1)
            found = np.where(words[at] == wanted, np.frombuffer(counts, np.int64)[at], 0)
        out.append((block, kind, segment, _planes(found, 8)))
    return pd.DataFrame(out, columns=["block", "kind", "segment", "counts"])


def _scored(train_tokens: int, vocabulary: int, train_docs: int, weight: float):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({n: [] for n in ("doc_id", "no_id", "n_tokens", "n_known", "base_score", "score")})
        tokens, lengths = _distinct(docs["text"])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        answers = answers.sort_values("segment")
        words, bigrams = (answers.loc[answers["kind"] == kind, "counts"] for kind in ("word", "bigram"))
        count = np.concatenate([_numbers(c, 8) for c in words]).astype(np.float64)[np.unique(tokens, return_inverse=True)[1]]
        level = np.frombuffer(b"".join(bigrams), np.uint8)[np.unique(_pairs(tokens), return_inverse=True)[1]]
        scale = train_tokens + 0.5 * (vocabulary + 1)
        single = (count + 0.5) / scale
        history = np.roll(count, 1)
        history[starts] = train_docs
        seen = np.flatnonzero((count > 0) & (history > 0))
        after = np.zeros(len(tokens))
        after[seen] = np.minimum(1.0, _lower_bounds(level[seen].astype(np.int64) - 1, 1) / history[seen])
        total = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({
            "doc_id": docs["doc_id"].array, "no_id": docs["no_id"].array, "n_tokens": lengths,
            "n_known": total((count > 0).astype(np.int64)), "base_score": total(np.log10(single)),
            "score": total(np.log10(weight * after + (1 - weight) * single)),
        })

    return run


def scores(docs: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of every text.

    ``base_score`` is the add-half unigram score by exact counts, ``score`` that of the bigram model. Learned from the
    documents that are not held out (a row without a doc_id is not). A null or empty text is its end alone. With nothing
    to learn from, every word has the same chance. Rows that repeat are counted and scored each; further columns are
    ignored.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    segments, blocks = (max(1, math.ceil(chars / 6 / n)) for n in (SEGMENT_TOKENS, BLOCK_TOKENS))
    added = pin(
        docs.where(~held_out()).select("text").mapInPandas(_counted(segments), _PACKED).groupBy("kind", "segment")
        .applyInPandas(_added, _PACKED + ", n long, total long, ends long")
    )
    learned = added.where("kind = 'word'").agg(F.sum("total"), F.sum("n"), F.sum("ends")).first()
    train_tokens, vocabulary, train_docs = (x or 0 for x in learned)

    dealt = with_plain_id(docs, "text").withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asks = dealt.groupBy("block").applyInPandas(_asks(segments), "block int, kind string, segment int, grams binary")
    answers = asks.groupBy("kind", "segment").cogroup(
        added.select("kind", "segment", "grams", "counts").groupBy("kind", "segment")).applyInPandas(
        _answers, "block int, kind string, segment int, counts binary")
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _scored(train_tokens, vocabulary, train_docs, weight),
        "doc_id long, no_id boolean, n_tokens long, n_known long, base_score double, score double")
    return with_own_id(found).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known",
                                     F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
