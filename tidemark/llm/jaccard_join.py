"""N-gram Jaccard join: MinHash bands find candidates, exact shingle sets decide.

Texts with equal shingle sets are one node. A node's signature is cut into ``trees`` bands of ``depth`` minima. Nodes
meet where a band has the same first minima, as many as give the target recall at the threshold: a constant of the
parameters (4 of 6 by default, the others are not used), so this is fixed banding and no forest of tries.
What meets in no band is alone. The others fall into connected candidate sets, so all links lie inside these; within a
set all pairs of nodes are compared by exact intersection, in blocks of bounded size as products of incidence matrices.
Only per-node sums and a spanning star of the links leave a task: never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import (
    U64, WordHashes, chunks, mixed, pin, shingles, signed, text_key, with_own_id, with_plain_id, words_of,
)
from tidemark.llm.components import components

SIZE = 5
SIMILARITY = 0.8
TREES = 20
DEPTH = 6
RECALL = 0.9999
BLOCK = 256  # nodes on one side of a comparison
_COLUMNS = 2048  # shingles per incidence matrix


def recall_at(prefix: int, trees: int, similarity: float) -> float:
    return 1 - (1 - similarity**prefix) ** trees


def matched_prefix(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which the forest still finds a pair at the threshold with the target recall."""
    prefix = depth
    while prefix > 1 and recall_at(prefix, trees, similarity) < recall:
        prefix -= 1
    return prefix


def minima(values: np.ndarray, count: int) -> np.ndarray:
    """The smallest of ``count`` hash functions over a set, as 32-bit numbers."""
    factors = mixed(np.arange(1, count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    out = np.full(count, U64(2**64 - 1))
    for at in range(0, len(values), 1 << 14):
        np.minimum(out, (values[at : at + (1 << 14), None] * factors).min(axis=0), out=out)
    return (out >> U64(32)).astype(np.uint32)


def _signatures(size: int, trees: int, depth: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in chunks(frames, 500):
            keys, sizes, forest = [], [], []
            for text in frame["text"]:
                found = shingles(hashes.of(words_of(text)), size)
                sizes.append(len(found))
                keys.append((np.bitwise_xor.reduce(found) if len(found) else U64(0), mixed(found).sum(dtype=U64)))
                forest.append(minima(found, trees * depth).tobytes() if len(found) else None)
            both = signed(np.array(keys, U64).reshape(-1, 2))
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "no_id": frame["no_id"].array, "set_1": both[:, 0],
                                "set_2": both[:, 1], "size": sizes, "signature": forest})

    return run


def _branches(trees: int, depth: int, prefix: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(frames, 2000):
            leaves = np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(len(frame), trees, depth)
            key = np.broadcast_to(np.arange(trees, dtype=U64), (len(frame), trees))
            for level in range(prefix):
                key = mixed(key * U64(0x9E3779B97F4A7C15) + leaves[:, :, level].astype(U64))
            yield pd.DataFrame({"node": np.repeat(frame["node"].to_numpy(), trees), "grp": signed(key).ravel()})

    return run


def _shingled(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in chunks(frames, 500):
            yield pd.DataFrame({n: frame[n].array for n in ("node", "copies", "part", "blocks", "block")} | {
                "shingles": [shingles(hashes.of(words_of(t)), size).tobytes() for t in frame["text"]]})

    return run


def similar_pairs(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets reach the similarity (square boolean matrix, diagonal false)."""
    lengths = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    often = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    use = often[place]
    owner, place = owner[use], column[place[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(often.sum()), _COLUMNS):
        low, high = np.searchsorted(place, [at, at + _COLUMNS])
        present = np.zeros((len(sets), _COLUMNS), np.float32)
        present[owner[low:high], place[low:high] - at] = 1
        common += present @ present.T
    common = common.astype(np.float64)
    out = common >= similarity * (lengths[:, None] + lengths[None, :] - common) - 1e-9
    np.fill_diagonal(out, False)
    return out


def _compare(similarity: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (part, first, second), group in frame.groupby(["part", "first", "second"], sort=False):
            if len(group) < 2:
                continue
            node, copies, block = (group[n].to_numpy() for n in ("node", "copies", "block"))
            linked = similar_pairs([np.frombuffer(s, U64) for s in group["shingles"]], similarity)
            if first != second:  # pairs within a block belong to that block's own task
                linked &= block[:, None] != block[None, :]
            links = linked @ copies
            lead = np.arange(len(node))
            while True:  # smallest position over direct links, until nothing changes
                near = np.where(linked, lead[None, :], len(node)).min(axis=1)
                low = np.minimum(lead, near)
                low = low[low]
                if (low == lead).all():
                    break
                lead = low
            keep = links > 0
            out.append(pd.DataFrame({"node": node[keep], "links": links[keep], "lead": node[lead[keep]],
                                     "first": first, "second": second, "part": part}))
        return pd.concat(out) if out else pd.DataFrame({n: np.empty(0, np.int64) for n in (
            "node", "links", "lead", "first", "second", "part")})

    return run


def similar_documents(
    docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH,
    recall: float = RECALL,
) -> DataFrame:
    """(doc_id, class_id, n_links): one row per input row.

    ``n_links`` counts the other documents whose sets of ``size``-word shingles have a Jaccard similarity of
    ``similarity`` or more; ``class_id`` is the smallest doc_id that such links reach, directly or over others. Words are
    separated by white space and taken as they are. A text of fewer than ``size`` words is one shingle; an empty or null
    text has none, links to nothing and is its own class. Rows that repeat a doc_id are one document with several
    texts: their classes join, and every row counts as a copy. A row without a doc_id takes no part (class null, no links). Further columns are ignored.
    """
    prefix = matched_prefix(similarity, trees, depth, recall)
    rows = pin(with_own_id(with_plain_id(docs, "text").mapInPandas(
        _signatures(size, trees, depth),
        "doc_id long, no_id boolean, set_1 long, set_2 long, size int, signature binary")))
    sets = rows.where("size > 0 and doc_id is not null")
    nodes = pin(sets.groupBy("set_1", "set_2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))
    leaders = sets.join(nodes.withColumnRenamed("node", "doc_id"), ["doc_id", "set_1", "set_2"]).select(
        F.col("doc_id").alias("node"), "signature")
    branches = pin(leaders.mapInPandas(_branches(trees, depth, prefix), "node long, grp long").distinct())
    crowded = pin(branches.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    candidates = components(branches.join(crowded, "grp"))
    verified = pin(_verified(docs, nodes, candidates, size, similarity))

    # a star per comparison: each linked node and its leader
    star = F.xxhash64("part", "first", "second", "lead").alias("grp")
    stars = verified.select("node", star).union(verified.select(F.col("lead").alias("node"), star)).distinct()
    classes = components(stars)
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = pin(nodes.join(classes, "node", "left").join(links, "node", "left").select(
        "set_1", "set_2", F.coalesce("label", "node").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    taking_part = F.col("doc_id").isNotNull() & (F.col("size") > 0)
    found = rows.select("doc_id", "set_1", "set_2", "size").join(known, ["set_1", "set_2"], "left")
    return found.select(
        "doc_id", F.when(taking_part, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(taking_part, F.col("n_links")).otherwise(0).cast("long").alias("n_links"))


def _verified(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links of all pairs within each candidate set: small sets share a task, large ones are cut into pairs of blocks."""
    sizes = pin(candidates.groupBy("label").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = (
        candidates.join(sizes, "label").join(nodes.select("node", "copies").groupBy("node").agg(
            F.max("copies").alias("copies")), "node")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("block", F.expr("cast(pmod(xxhash64(node, 17), blocks) as int)"))
    )
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text", text_key().alias("text_key"))
    members = pin(
        texts.join(parts.select("node", "copies", F.col("label").alias("part"), "blocks", "block"), "node")
        .dropDuplicates(["node", "text_key"]).drop("text_key")
        .mapInPandas(_shingled(size), "node long, copies long, part long, blocks int, block int, shingles binary")
        .where("length(shingles) > 0")
    )
    meets = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({
        "first": F.least("block", "other"), "second": F.greatest("block", "other")})
    bins = max(1, math.ceil(total / BLOCK))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("part"), F.lit(bins))).otherwise(
        F.xxhash64("part", "first", "second"))
    return meets.withColumn("task", task).drop("blocks", "other").groupBy("task").applyInPandas(
        _compare(similarity), "node long, links long, lead long, first int, second int, part long")


def brute_force(rows: list[tuple[int, str | None]], size: int = SIZE, similarity: float = SIMILARITY) -> dict[int, tuple]:
    """(class_id, n_links) by comparing all pairs, for tests."""
    sets = {}
    for doc, text in rows:
        words = words_of(text)
        k = min(size, len(words))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    label, links = {d: d for d in sets}, {d: [] for d in sets}
    holders: dict[tuple, list[int]] = {}
    for doc, found in sets.items():
        for s in found:
            holders.setdefault(s, []).append(doc)
    for doc, found in sets.items():
        common: dict[int, int] = {}
        for s in found:
            for other in holders[s]:
                common[other] = common.get(other, 0) + 1
        links[doc] = [o for o, n in common.items() if o != doc and n >= similarity * (len(found) + len(sets[o]) - n) - 1e-9]
    changed = True
    while changed:
        changed = False
        for doc, others in links.items():
            low = min([label[doc], *(label[o] for o in others)])
            changed, label[doc] = changed or low < label[doc], low
    return {d: (label[d], len(links[d])) for d in sets}
