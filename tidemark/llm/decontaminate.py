"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification.

Items are partitioned by the size of their shingle sets (up to 8, 16, 32, ... shingles). A long document hides a short
item from MinHash, so for each partition the document is read as segments of twice the partition's upper size, each half
overlapping the next: an item that occurs in one piece lies whole in a segment no more than four times its size, and its
containment threshold becomes a Jaccard similarity of at least 0.19 there. Segment and item are candidates if any of
``FUNCTIONS`` minima agree, which such a pair misses with a chance below 0.0001. Items of at most four shingles are
looked up shingle by shingle. Every candidate is verified on the exact shingle sets of the item and the whole document.

The items are the stated query set: they are read in blocks of bounded size, every block is broadcast on its own and
searched in one pass over the documents, so neither side is ever shuffled for the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, Runs, WordHashes, chunks, mixed, pin, shingles, stacked, text_key, words_of

SIZE = 5
CONTAINMENT = 0.8
FUNCTIONS = 48
DIRECT = 4
BLOCK_ITEMS = 20_000
BLOCK_WORDS = 2_000_000
_FACTORS = mixed(np.arange(1, FUNCTIONS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_SLICE = 1 << 13


def block_minima(values: np.ndarray, width: int) -> np.ndarray:
    """(functions, blocks): minima of every hash function over consecutive blocks of ``width`` values."""
    out = []
    step = max(width, _SLICE // width * width)
    for at in range(0, len(values), step):
        part = ((values[None, at : at + step] * _FACTORS[:, None]) >> U64(32)).astype(np.uint32)
        out.append(np.minimum.reduceat(part, np.arange(0, part.shape[1], width), axis=1))
    return np.concatenate(out, axis=1)


class Partition:
    """Sketches of the items of one size class."""

    def __init__(self, width: int):
        self.width = width
        self.marks = np.zeros((FUNCTIONS, 1 << 16), bool)
        self.found: dict[tuple[int, int], list[int]] = {}

    def add(self, item: int, values: np.ndarray) -> None:
        for f, low in enumerate(block_minima(values, len(values))[:, 0].tolist()):
            self.marks[f, low & 0xFFFF] = True
            self.found.setdefault((f, low), []).append(item)

    def search(self, halves: np.ndarray) -> set[int]:
        whole = halves if halves.shape[1] == 1 else np.minimum(halves[:, :-1], halves[:, 1:])
        f, at = np.nonzero(self.marks[np.arange(FUNCTIONS)[:, None], whole & np.uint32(0xFFFF)])
        out: set[int] = set()
        for key in set(zip(f.tolist(), whole[f, at].tolist(), strict=True)):
            out.update(self.found.get(key, ()))
        return out


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], size: int = SIZE):
        hashes = WordHashes()
        self.size, self.sets, self.partitions = size, {}, {}
        self.direct: dict[int, dict[int, list[int]]] = {}
        for at, (_, text) in enumerate(items):
            words = hashes.of(words_of(text))
            if not len(words):
                continue
            values, length = shingles(words, size), min(size, len(words))
            self.sets[at] = items[at][0], length, values
            if len(values) <= DIRECT or length < size:
                for v in values.tolist():
                    self.direct.setdefault(length, {}).setdefault(v, []).append(at)
            else:
                width = 1 << (len(values) - 1).bit_length()
                self.partitions.setdefault(width, Partition(width)).add(at, values)

    def candidates(self, runs: Runs) -> set[int]:
        out: set[int] = set()
        for length, owners in self.direct.items():
            for v in owners.keys() & set(runs.grams(length).tolist()):
                out.update(owners[v])
        grams = runs.grams(self.size)
        halves = None
        for width in sorted(self.partitions) if len(grams) else ():
            if halves is None:
                halves, wide = block_minima(grams, width), width
            while wide < width:  # neighbouring blocks joined
                halves, wide = np.minimum.reduceat(halves, np.arange(0, halves.shape[1], 2), axis=1), wide * 2
            out |= self.partitions[width].search(halves)
        return out

    def inside(self, hashes: np.ndarray, containment: float) -> list[tuple[int, float]]:
        """(item_id, share of its shingles in the document) of all items contained in a document."""
        runs = Runs(hashes)
        found, sets = [], {}
        for at in self.candidates(runs):
            item, length, values = self.sets[at]
            if length not in sets:
                sets[length] = np.unique(runs.grams(length))
            share = np.isin(values, sets[length], assume_unique=True).sum() / len(values)
            if share >= containment:
                found.append((item, float(share)))
        return found


def blocks(items: DataFrame, size: int = SIZE) -> Iterator[Items]:
    """The items in blocks that fit into a broadcast, read partition by partition."""
    block, words = [], 0
    for row in items.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        words += len(words_of(row[1]))
        if len(block) >= BLOCK_ITEMS or words >= BLOCK_WORDS:
            yield Items(block, size)
            block, words = [], 0
    if block:
        yield Items(block, size)


def _row_key() -> list[F.Column]:
    return [F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc"), text_key().alias("text_key")]


def _search(shared, containment: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, items = WordHashes(), shared.value
        for frame in chunks(frames, 500):
            out = []
            for doc, key, text in zip(frame["doc"], frame["text_key"], frame["text"], strict=True):
                found = items.inside(hashes.of(words_of(text)), containment)
                if found:
                    out.append({"doc": np.full(len(found), doc), "text_key": np.full(len(found), key),
                                "item_id": np.array([i for i, _ in found]), "share": np.array([s for _, s in found])})
            yield stacked(out, ["doc", "text_key", "item_id", "share"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, size: int = SIZE) -> DataFrame:
    """(doc, text_key, item_id, share): which items each text contains."""
    texts = docs.where("text is not null").select(*_row_key(), "text")
    schema = "doc long, text_key long, item_id long, share double"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(items, size):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.unionAll(pin(texts.mapInPandas(_search(shared, containment), schema)))
        shared.unpersist()
    return out.distinct()


def contamination(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, size: int = SIZE) -> DataFrame:
    """(doc_id, n_items, items, max_share): one row per document.

    An item is in a document if at least ``containment`` of the item's ``size``-word shingles occur there. Words are
    separated by white space and taken as they are; an item of fewer words is one shingle. ``items`` lists the ids in
    ascending order, joined by commas; ``max_share`` is null without any. Items without an id, words or text are in no
    document, null and empty texts hold none, an item repeated under one id counts once. Rows that repeat are judged
    alike, also without a doc_id; further columns are ignored.
    """
    found = contained_items(docs, items, containment, size).groupBy("doc", "text_key", "item_id").agg(F.max("share").alias("share"))
    per_doc = pin(found.groupBy("doc", "text_key").agg(
        F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item_id")).cast("array<string>")).alias("items"),
        F.max("share").alias("max_share")))
    return docs.select("doc_id", *_row_key()).join(per_doc, ["doc", "text_key"], "left").select(
        "doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), "max_share")


def clean(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, size: int = SIZE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text contains no item."""
    dirty = pin(contained_items(docs, items, containment, size).select(
        F.col("doc").alias("_doc"), F.col("text_key").alias("_key")).distinct())
    doc, key = _row_key()
    return docs.join(dirty, (doc == dirty["_doc"]) & (key == dirty["_key"]), "left_anti")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents
), d AS (
  SELECT DISTINCT doc_id, array_to_string(a[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, a, unnest(range(1, len(a) - 3)) AS i FROM w WHERE len(a) >= 5)
), b AS (
  SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM benchmark
), q AS (
  SELECT DISTINCT item_id, array_to_string(a[i : i + 4], ' ') AS s
  FROM (SELECT item_id, a, unnest(range(1, len(a) - 3)) AS i FROM b WHERE len(a) >= 5)
), sized AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
hit AS (
  SELECT doc_id, item_id, count(*) / any_value(n) AS share
  FROM d JOIN q USING (s) JOIN sized USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(n) >= 0.8
), per_doc AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, max(share) AS max_share
  FROM hit GROUP BY doc_id
)
SELECT doc_id, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items, max_share
FROM documents LEFT JOIN per_doc USING (doc_id)
"""
