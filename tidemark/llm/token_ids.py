"""Token-ID output: texts to ids, ids to files of independently coded blocks, and back.

Documents are put in order of doc_id by a range shuffle and encoded where they land. The files are Parquet with one
binary value a row, a *frame*:

    magic "TKF3" | u32 documents | u32 blocks | u64 ids | u32 bytes of the next line
    share of 2**16 of each id below 65,536 in the frame (u32, deflated): the coder's order 0
    per document: i64 doc_id, u8 1 if it has one, u32 ids
    per block:    u32 ids, u32 bytes, u32 crc32 of its ids (little-endian u32)
    the blocks' range-coded bytes, one after the other

(all little-endian). A frame holds whole documents, some millions of ids at most unless one document has more. Blocks have
up to ``BLOCK`` ids, each with a model of its own (``range_coder``), and are checked against their crc32 when read. The
number of all ids before a frame comes from the row counts beside the frames, never from the data.
"""

from __future__ import annotations

import itertools
import json
import operator
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import range_coder
from tidemark.llm.common import text_key, with_own_id, with_plain_id
from tidemark.session import shared_dir

END = 1
BLOCK = 2048
LEAST_BLOCK = 256
FRAME = 1 << 21
CACHED = 500_000  # parts remembered, some 20 MB
GROUP = 48 << 20  # bytes of pieces whose distinct ones are tokenized together
SLICE = 1 << 17  # pieces cut at a time
WRITE_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))  # beside a frame being coded
# how the vocabulary's byte-level step shows bytes that do not print: the further letters in turn; a space is in no part
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {byte: chr(256 + n) for n, byte in enumerate(b for b in range(256) if b not in _SHOWN) if byte != 32}
_HEAD, _DOC, _BLOCK = struct.Struct("<4sIIQI"), np.dtype([("doc", "<i8"), ("has", "u1"), ("n", "<u4")]), np.dtype(
    [("n", "<u4"), ("bytes", "<u4"), ("crc", "<u4")])
_ID = operator.attrgetter("id")
FILE_SCHEMA = "part int, frame int, n_ids long, data binary"


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The values from each start to its end, one after the other."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return values[np.arange(sizes.sum()) + np.repeat(starts - before, sizes)]


class Encoder:
    """A tokenizer that gets the distinct pieces between white space of many texts, if it is one whose pieces stand alone.

    ``split`` cuts a batch of texts, ``coded`` gives the ids of several such batches.

    With the normalizer and pre-tokenizer named here no token spans white space, so a text's ids are those of its pieces,
    one after the other. Pieces of Latin letters are further cut as the tokenizer's own pattern cuts them; those parts need
    none of its other steps and go to its model, and their ids are remembered. The memory is bounded: when it is full, only
    the parts that were used last stay. Any other tokenizer is given whole texts.
    """

    # Fixed value: the split pattern of the vocabulary file
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # the same for letters up to U+017F, and line ends; of these letters I with a dot has a small form outside
    _LETTERS, _DIGITS = "a-zªµºß-öø-ſ", "0-9²³¹¼½¾"
    _LINES = re.compile(rf"[{_LETTERS}]+|\n|[{_DIGITS}]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t\n\r\x0b\x0c\x85\xa0{_LETTERS}{_DIGITS}]+")
    _OTHER = r"[^\x{0}-\x{12F}\x{131}-\x{17F}]|<\|"

    NORMALIZER = {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

    def __init__(self, description: str):
        self.tokenizer = Tokenizer.from_str(description)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        told = json.loads(description)
        self.alone = (
            told.get("normalizer") == self.NORMALIZER and told.get("pre_tokenizer") == self.PRE_TOKENIZER
            and all("<|" in t["content"] and len(t["content"].split()) == 1 for t in told.get("added_tokens") or []))
        # no byte is left out, if every one has ids with and without the suffix of a part's end
        vocabulary, suffix = self.tokenizer.get_vocab(with_added_tokens=False), told["model"].get("end_of_word_suffix")
        shown = [*map(chr, _SHOWN), *_BYTE_LEVEL.values()]
        self.alone = self.alone and bool(suffix) and all(c in vocabulary and c + suffix in vocabulary for c in shown)
        self._keep(np.empty(0, np.int64))

    def _keep(self, used: np.ndarray) -> None:
        """Start the memory anew with the parts of these numbers; none: with the line end, which has no ids."""
        if not len(used):
            # a part's number is its place; by numbers, where its ids start and end
            self.known, self.ends, self.kept = pa.array(["\n"], pa.large_string()), np.zeros(2, np.int64), np.empty(0, "<u2")
        else:
            starts, ends = self.ends[used], self.ends[used + 1]
            self.known, self.kept = self.known.take(pa.array(used)), _spans(self.kept, starts, ends)
            self.ends = np.concatenate([[0], np.cumsum(ends - starts)])
        self.used = used

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).astype("<u2").tobytes()
                for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Number new lower-case parts of Latin letters, digits or signs, those in ASCII first, and keep their ids."""
        ids, sizes = [], []
        for at in range(0, len(parts), 1024):
            shown = " ".join(parts[at : at + 1024])
            if not (shown.isascii() and shown.isprintable()):
                shown = shown.encode().decode("latin-1").translate(_BYTE_LEVEL)
            for part in shown.split(" "):
                tokens = self.model.tokenize(part)
                sizes.append(len(tokens))
                ids.extend(map(_ID, tokens))
        self.ends = np.concatenate([self.ends, np.cumsum(sizes) + self.ends[-1]])
        self.kept = np.concatenate([self.kept, np.array(ids, "<u2")])
        self.known = pa.concat_arrays([self.known, pa.array(parts, pa.large_string())])

    def _numbers(self, found: pa.ChunkedArray) -> np.ndarray:
        """The numbers of these parts, new ones learnt."""
        if len(self.known) > CACHED:
            self._keep(self.used if len(self.used) <= CACHED else self.used[:0])
        numbers = pc.fill_null(pc.index_in(found, value_set=self.known), -1).to_numpy()
        unknown = numbers < 0
        if unknown.any():
            numbers, missing, count = numbers.copy(), found.filter(pa.array(unknown)), len(self.known)
            self._learn(sorted(missing.unique().to_numpy(zero_copy_only=False).tolist(), key=str.isascii, reverse=True))
            numbers[unknown] = pc.index_in(missing, value_set=self.known.slice(count)).to_numpy() + count
        self.used = np.flatnonzero(np.bincount(numbers, minlength=1))
        return numbers

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of these distinct pieces has, and the ids of all."""
        if not self.alone:
            rest = self._encode(pieces.to_pylist())
            return np.array([len(ids) // 2 for ids in rest], np.int64), np.frombuffer(b"".join(rest), "<u2")
        other = pc.match_substring_regex(pieces, self._OTHER)
        plain, found = pieces.filter(pc.invert(other)), [self.known[:0]]
        for at in range(0, len(plain), SLICE):
            lines = "\n".join([*plain[at : at + SLICE].to_numpy(zero_copy_only=False).tolist(), ""]).lower()
            found.append(pa.array(self._LINES.findall(lines), pa.large_string()))
        numbers = self._numbers(pa.chunked_array(found))
        starts, ends = self.ends[numbers], self.ends[numbers + 1]
        coded = _spans(self.kept, starts, ends)
        ends = np.cumsum(ends - starts)[numbers == 0]  # each piece ends with a line end
        rest = self._encode(pieces.filter(other).to_numpy(zero_copy_only=False).tolist())
        sizes, other = np.empty(len(pieces), np.int64), other.to_numpy(zero_copy_only=False)
        sizes[~other] = np.diff(ends, prepend=0)
        sizes[other] = [len(ids) // 2 for ids in rest]
        if not rest:
            return sizes, coded
        ids, mine = np.empty(int(sizes.sum()), "<u2"), np.repeat(other, sizes)
        ids[~mine], ids[mine] = coded, np.frombuffer(b"".join(rest), "<u2")
        return sizes, ids

    def split(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of the texts (null: none), and how many each text has."""
        raw = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
        whole = pa.array(raw, pa.large_binary()).cast(pa.large_string())
        if not self.alone:
            return whole, np.ones(len(whole), np.int64)
        pieces = pc.ascii_split_whitespace(whole)
        return pieces.flatten(), pc.list_value_length(pieces).to_numpy()

    def coded(self, batches: list[tuple[pa.Array, np.ndarray]], end: int = END) -> Iterator[list[np.ndarray]]:
        """For each of these batches, the ids of each text and the end id."""
        pieces = pa.chunked_array([p for p, _ in batches]).dictionary_encode()
        sizes, ids = self._pieces(pieces.chunk(0).dictionary)
        # the end id is one more piece
        offsets = np.concatenate([[0], np.cumsum(sizes), [len(ids) + 1]]) * 2
        ids = pa.Array.from_buffers(
            pa.large_binary(), len(sizes) + 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.append(ids, np.array([end], "<u2")))])
        for chunk, (_, counts) in zip(pieces.chunks, batches, strict=True):
            stops = np.cumsum(counts)
            taken = ids.take(pa.array(np.insert(chunk.indices.to_numpy(), stops, len(sizes))))
            ends, data = np.frombuffer(taken.buffers()[1], np.int64), np.frombuffer(taken.buffers()[2], "<u2")
            ends = ends[np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])] // 2
            yield [data[a:b] for a, b in itertools.pairwise(ends.tolist())]

    def ids(self, texts: list[str | None], end: int = END) -> list[np.ndarray]:
        """The ids of each text (null: none) and the end id."""
        return next(self.coded([self.split(texts)], end))


_encoders: dict[int, Encoder] = {}


def _encoder(description: str) -> Encoder:
    """One a worker, as its memory serves all tasks that the worker runs."""
    key = zlib.crc32(description.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(description)
    return _encoders[key]


def crcs_of(ids: np.ndarray, sizes: np.ndarray) -> list[int]:
    """The crc32 of the first so many ids, of the next so many, and so on."""
    data = memoryview(ids.astype("<u4").view(np.uint8))
    return [zlib.crc32(data[a:b]) for a, b in itertools.pairwise([0, *(np.cumsum(sizes, dtype=np.int64) * 4).tolist()])]


def pack(docs: list[tuple[int, bool, np.ndarray]]) -> bytes:
    """A frame of (doc_id, whether it has one, ids) in their order."""
    ids = np.concatenate([d[2] for d in docs])
    size = int(np.clip(len(ids) // 1024, LEAST_BLOCK, BLOCK))  # many blocks side by side are coded faster
    blocks = [ids[at : at + size] for at in range(0, len(ids), size)]
    order_0 = range_coder.shares(ids)
    coded, table = range_coder.encode(blocks, order_0), zlib.compress(order_0.astype("<u4").tobytes(), 1)
    index = np.array([(d, has, len(i)) for d, has, i in docs], _DOC)
    crcs = crcs_of(ids, [len(b) for b in blocks])
    sizes = np.array([(len(b), len(c), crc) for b, c, crc in zip(blocks, coded, crcs, strict=True)], _BLOCK)
    return b"".join([_HEAD.pack(b"TKF3", len(docs), len(blocks), len(ids), len(table)), table, index.tobytes(), sizes.tobytes(), *coded])


def unpack(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(documents, ids) of a frame; raises ValueError if it is damaged."""
    if len(frame) < _HEAD.size:
        raise ValueError("not a frame of token ids")
    magic, n_docs, n_blocks, n_ids, n_table = _HEAD.unpack_from(frame)
    if magic != b"TKF3":
        raise ValueError("not a frame of token ids")
    at = _HEAD.size + n_table
    try:
        order_0 = np.frombuffer(zlib.decompress(frame[_HEAD.size : at]), "<u4")
    except zlib.error as error:
        raise ValueError("frame of token ids with a damaged table") from error
    docs = np.frombuffer(frame, _DOC, n_docs, at)
    blocks = np.frombuffer(frame, _BLOCK, n_blocks, at + docs.nbytes)
    starts = at + docs.nbytes + blocks.nbytes + np.concatenate([[0], np.cumsum(blocks["bytes"], dtype=np.int64)])
    if starts[-1] != len(frame) or docs["n"].sum() != n_ids or blocks["n"].sum() != n_ids:
        raise ValueError("frame of token ids with a wrong length")
    parts = range_coder.decode([frame[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)], blocks["n"].tolist(), order_0)
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint16)
    if crcs_of(ids, blocks["n"]) != blocks["crc"].tolist():
        raise ValueError("block of token ids with a wrong checksum")
    return docs, ids


def _encoded(frames: Iterator[pd.DataFrame], encoder: Encoder, end: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """The keys of each batch and the ids of its texts. Several batches are tokenized together, of which only pieces are held."""
    keys, batches, size = [], [], 0
    for rows in frames:
        keys.append(rows[["doc_id", "no_id"]])
        batches.append(encoder.split(list(rows["text"])))
        size += batches[-1][0].nbytes
        if size >= GROUP:
            yield from zip(keys, encoder.coded(batches, end), strict=True)
            keys, batches, size = [], [], 0
    if batches:
        yield from zip(keys, encoder.coded(batches, end), strict=True)


def _frames(shared, end: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, held, count, number = _encoder(shared.value), TaskContext.get().partitionId(), [], 0, 0

        def flush():
            return pd.DataFrame({"part": [part], "frame": [number], "n_ids": [count], "data": [pack(held)]})

        for keys, coded in _encoded(frames, encoder, end):
            for doc, none, ids in zip(keys["doc_id"], keys["no_id"], coded, strict=True):
                if held and count + len(ids) > FRAME:
                    yield flush()
                    held, count, number = [], 0, number + 1
                held.append((doc, not none, ids))
                count += len(ids)
        if held:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encode every text (null: empty) with the tokenizer file and write the ids in order of doc_id.

    Each document ends with the id ``end``. Rows without a doc_id come first; rows that repeat one follow each other. The
    vocabulary must have at most 65,536 ids. Further columns are ignored.
    """
    with open(tokenizer, encoding="utf-8") as file:
        description = file.read()
    if Tokenizer.from_str(description).get_vocab_size() > 1 << 16:
        raise ValueError("ids must be below 65,536")
    shared = docs.sparkSession.sparkContext.broadcast(description)
    rows = with_plain_id(docs, "text", text_key().alias("text_key"))
    order = [F.col("no_id").desc(), F.col("doc_id"), F.col("text_key")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("text_key")
    conf = docs.sparkSession.conf
    batch, before = WRITE_BATCH[0], conf.get(WRITE_BATCH[0])
    conf.set(*WRITE_BATCH)
    try:
        ordered.mapInPandas(_frames(shared, end), FILE_SCHEMA).write.parquet(path)
    finally:
        conf.set(batch, before)


def _documents(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """The documents of each frame, all their ids and where each one's end."""
    for frame in frames:
        for part, number, data in zip(frame["part"], frame["frame"], frame["data"], strict=True):
            docs, ids = unpack(data)
            ends = np.cumsum(docs["n"], dtype=np.int64)
            yield pd.DataFrame({
                "part": part, "frame": number, "place": np.arange(len(docs)), "doc_id": docs["doc"], "no_id": docs["has"] == 0,
                "before": ends - docs["n"],
            }), ids, ends


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for docs, ids, ends in _documents(frames):
        yield docs.assign(ids=[ids[a:b].astype(np.int32) for a, b in zip(docs["before"], ends, strict=True)])


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for docs, ids, ends in _documents(frames):
        n = ends - docs["before"].to_numpy()
        yield docs.assign(n_tokens=n, ids_crc32=crcs_of(ids, n))


def read(spark, path: str) -> DataFrame:
    """(part, frame, place, doc_id, ids): the documents of the files, in the order of the first three."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path).mapInPandas(
        _texts, "part int, frame int, place int, doc_id long, no_id boolean, before long, ids array<int>")
    return with_own_id(rows).drop("before")


def summary(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files: ids before it, its ids, their checksum."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # ids before each frame: within its part, and in the parts before
    sizes = files.groupBy("part", "frame").agg(F.sum("n_ids").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "frame", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inner")).join(parts, "part")
    rows = files.mapInPandas(
        _digests, "part int, frame int, place int, doc_id long, no_id boolean, before long, n_tokens long, ids_crc32 long")
    return with_own_id(rows).join(starts, ["part", "frame"]).select(
        "doc_id", (F.col("base") + F.col("inner") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def written(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write the ids of ``docs`` into the cluster's shared folder and read them back as ``summary``."""
    spark = docs.sparkSession
    path = shared_dir(spark, "tidemark-llm", uuid.uuid4().hex)
    write(docs, path, tokenizer, end)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return summary(spark, path)
