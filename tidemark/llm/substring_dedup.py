"""Substring dedup: winnowed blocks of documents, matched by hash with those of all documents.

Every text is cut into overlapping reference blocks. Each window of ``window`` words picks the smallest hashed seed (run
of ``seed`` words) inside it, the leftmost if there are several; neighbouring windows with the same pick form a block.
The pick depends on the window's words alone, so equal windows of two documents lie in blocks of the same seed. The index
holds, per seed, the smallest doc_id and whether all its blocks are equal. A block found whole in a document with a
smaller id is a duplicate. Where blocks share their seed but not all their words, the first document of every block variant
looks its windows up one by one. The words removed are the union of all windows found: there is no greedy parse into
factors. So no pair of documents is ever formed, and a block that a third of all documents share is one index row.

Seeds, blocks and windows are told apart by two independent 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import (
    U64, Runs, WordHashes, chunks, mixed, pin, signed, stacks, text_key, with_own_id, with_plain_id, words_of,
)

WINDOW = 50
SEED = 20
_BLOCK = "doc_id long, text_key long, seed long, block long, first int, last int"
_LOW = U64(0xFFFFFFFF)


def reference_blocks(hashes: np.ndarray, window: int = WINDOW, seed: int = SEED) -> dict[str, np.ndarray]:
    """Blocks of one text: hashed seed, hashed words, first and last window start."""
    runs, count = Runs(hashes), len(hashes) - window + 1
    if count <= 0:
        return {n: np.empty(0, np.int64) for n in ("seed", "block", "first", "last")}
    seeds = runs.grams(seed)
    least = (seeds & ~_LOW) | np.arange(len(seeds), dtype=U64)
    width, reach = window - seed + 1, 1
    while reach * 2 <= width:  # minima over 2, 4, 8, ... positions, then over the whole width
        least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
    pick = (np.minimum(least[:count], least[width - reach : width - reach + count]) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, pick[1:] != pick[:-1]])
    last = np.r_[first[1:], count] - 1
    words = runs.between(first, last + window)
    shape = U64(1 << 20) * (last - first).astype(U64) + (pick[first] - first).astype(U64)
    return {"seed": signed(seeds[pick[first]]), "block": signed(mixed(words + shape)), "first": first, "last": last}


def _blocks(window: int, seed: int):
    def found(frames: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
        hashes = WordHashes()
        for frame in frames:
            for doc, key, text in zip(frame["doc_id"], frame["text_key"], frame["text"], strict=True):
                blocks = reference_blocks(hashes.of(words_of(text)), window, seed)
                n = len(blocks["seed"])
                yield {"doc_id": np.full(n, doc), "text_key": np.full(n, key)} | blocks

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return stacks(found(frames), ["doc_id", "text_key", "seed", "block", "first", "last"])

    return run


def _windows(window: int):
    def found(frames: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
        hashes = WordHashes()
        for frame in frames:
            for doc, key, text, blocks in zip(frame["doc_id"], frame["text_key"], frame["text"], frame["blocks"], strict=True):
                runs = Runs(hashes.of(words_of(text)))
                for block in blocks:
                    at = np.arange(block["first"], block["last"] + 1)
                    n = len(at)
                    yield {"doc_id": np.full(n, doc), "text_key": np.full(n, key), "seed": np.full(n, block["seed"]),
                           "words": signed(runs.between(at, at + window)), "first": at, "last": at}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return stacks(found(frames), ["doc_id", "text_key", "seed", "words", "first", "last"])

    return run


def duplicate_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, first, last): every window from start ``first`` to start ``last`` is in an earlier document.

    A row without a doc_id has no place in the order of documents: it takes no part.

    Groups that are joined on their own key are grouped by its complement, so that the join deals both sides anew and
    Spark can split hot seeds; they need no table between.
    """
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text", text_key().alias("text_key"))
    blocks = pin(texts.select("doc_id", "text_key", "text").mapInPandas(_blocks(window, seed), _BLOCK))
    flipped = F.bitwise_not("seed").alias("flipped")
    index = (
        blocks.groupBy(flipped)
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"), F.min("block").alias("low"), F.max("block").alias("high"))
        .where("n > 1").select(F.bitwise_not("flipped").alias("seed"), "owner", (F.col("low") != F.col("high")).alias("varies"))
    )
    shared = pin(blocks.join(index, "seed"))
    whole = shared.where("not varies and doc_id > owner")
    mixed_blocks = shared.where("varies").drop("owner", "varies")
    owners = (
        mixed_blocks.groupBy(flipped, "block").agg(F.min("doc_id").alias("owner"))
        .select(F.bitwise_not("flipped").alias("seed"), "block", "owner")
    )
    owned = pin(mixed_blocks.join(owners, ["seed", "block"]))
    looked_up = (
        owned.where("doc_id = owner").groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("seed", "first", "last")).alias("blocks"))
    )
    windows = pin(
        texts.join(looked_up, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "blocks")
        .mapInPandas(_windows(window), "doc_id long, text_key long, seed long, words long, first int, last int")
    )
    earliest = (
        windows.groupBy(flipped, "words").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("end"))
        .where("owner < end").select(F.bitwise_not("flipped").alias("seed"), "words", "owner")
    )
    found = windows.join(earliest, ["seed", "words"]).where("doc_id > owner")
    parts = ["doc_id", "text_key", "first", "last"]
    return whole.select(parts).unionAll(owned.where("doc_id > owner").select(parts)).unionAll(found.select(parts))


def _factors(spans, n_words: int, window: int) -> np.ndarray:
    """Which words lie in a duplicate window of ``window`` words: the union of all spans."""
    edges = np.zeros(n_words + 1, np.int64)
    if spans is not None and len(spans):
        first = np.array([s["first"] for s in spans])
        last = np.array([s["last"] for s in spans])
        np.add.at(edges, first, 1)
        np.add.at(edges, last + window, -1)
    return np.cumsum(edges[:-1]) > 0


def _without(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(frames, 500):
            texts = []
            counts = np.zeros((len(frame), 2), np.int64)
            for i, (text, spans) in enumerate(zip(frame["text"], frame["spans"], strict=True)):
                words = words_of(text)
                gone = _factors(spans, len(words), window)
                counts[i] = len(words), gone.sum()
                kept = [w for w, out in zip(words, gone, strict=True) if not out] if counts[i, 1] else words
                texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "no_id": frame["no_id"].array, "n_words": counts[:, 0], "n_removed": counts[:, 1], "kept": texts})

    return run


def without_duplicates(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every text less the words of windows that an earlier document has.

    Windows are judged on the input. One row per input row; a null or empty text has no words and an empty ``kept``;
    rows that repeat a doc_id are not earlier than each other; a row without a doc_id keeps all its words. Further
    columns of the input are ignored.
    """
    spans = duplicate_spans(docs, window, seed).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("first", "last")).alias("spans"))
    rows = docs.select("doc_id", "text", text_key().alias("text_key"))
    joined = with_plain_id(rows.join(spans, ["doc_id", "text_key"], "left"), "text", "spans")
    return with_own_id(joined.mapInPandas(
        _without(window), "doc_id long, no_id boolean, n_words long, n_removed long, kept string"))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by comparing word tuples, for tests."""
    owner: dict[tuple, int] = {}
    split = {doc: words_of(text) for doc, text in rows}
    for doc, words in split.items():
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            owner[run] = min(owner.get(run, doc), doc)
    out = {}
    for doc, words in split.items():
        gone = set()
        for i in range(len(words) - window + 1):
            if owner[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc] = len(words), len(gone), hashlib.sha256(kept).hexdigest()
    return out
