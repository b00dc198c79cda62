"""Faults found in round 3, on rows of their own."""

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import range_coder, token_ids
from tidemark.llm.common import BATCH_BYTES
from tidemark.sources import log as segments
from tidemark.streaming.native import PROVIDER, stateful_lateness


def test_keyed_lateness_runs_in_a_session_with_the_default_state_store(spark, tmp_path):
    plain = spark.newSession()
    plain.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    rows = plain.range(40).select(
        F.lit("t").alias("topic"), (F.col("id") % 2).cast("int").alias("partition"), F.col("id").alias("offset"),
        F.timestamp_seconds("id").alias("log_time"), F.col("id").cast("string").alias("event_id"), F.lit("a").alias("tenant_id"),
        F.lit("s").alias("source_id"), F.timestamp_seconds(F.when(F.col("id") == 38, 0).otherwise(F.col("id") * 60)).alias("timestamp"))
    rows.write.parquet(str(tmp_path / "log"))
    stream = plain.readStream.schema(rows.schema).parquet(str(tmp_path / "log"))
    running = stateful_lateness(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert running.awaitTermination(120) and running.exception() is None
    found = plain.read.parquet(str(tmp_path / "out"))
    assert found.count() == 40 and [r["offset"] for r in found.where("late").collect()] == [38]


def test_segments_are_written_in_row_groups_of_bounded_size(tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(segments, "SEGMENT_ROWS", 500)
    path = str(tmp_path / "log")

    def batches():
        for at in range(0, 1200, 40):
            yield pa.record_batch({
                "key": [b"k"] * 40, "value": [bytes([i % 251]) * 300 for i in range(at, at + 40)], "topic": ["t"] * 40,
                "partition": pa.array([int(i >= 1100) for i in range(at, at + 40)], pa.int32()),
                "offset": pa.array([None] * 40, pa.int64()), "timestamp": pa.array(range(at, at + 40), pa.timestamp("us", "UTC")),
                "headers": pa.array([[]] * 40, pa.list_(pa.struct([("key", pa.string()), ("value", pa.binary())])))})

    writer = segments.SegmentWriter({"path": path})
    writer.commit([writer.write(batches())])
    held = segments.Segments(path)
    files = {p: [first for first, _ in parts] for p, parts in held.files().items()}
    assert files == {0: [0, 520, 1040], 1: [0]} and held.ends() == {"0": 1100, "1": 100}
    for p, parts in held.files().items():
        for _, file in parts:
            meta = pq.ParquetFile(file).metadata
            assert all(meta.row_group(g).num_rows <= 80 for g in range(meta.num_row_groups)) and meta.num_row_groups >= (meta.num_rows + 79) // 80
    spans = held.spans({"0": 510, "1": 3}, {"0": 1050, "1": 100}, each=False)
    rows = {s.end: [o for b in held.rows(s) for o in b.column("offset").to_pylist()] for s in spans}
    assert rows == {1050: list(range(510, 1050)), 100: list(range(3, 100))}


def test_latin_parts_go_to_the_tokenizers_model_alone(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        encoder = token_ids.Encoder(file.read())
    texts = ["Plain words, it's 42 of THEM.", "Straße naïve \x01\x7f\xad ÿ~¡", "", None, "中文 and <|endoftext|> é", "\xa0x\x85y"]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    whole, encode = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda given: whole.extend(given) or encode(given))
    assert [ids.tolist() for ids in encoder.ids(texts)] == want
    assert sorted(whole) == ["<|endoftext|>", "中文"]


def test_texts_reach_the_coder_in_small_batches(spark, tmp_path, monkeypatch):
    docs = spark.range(64, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))
    spark.conf.set(*BATCH_BYTES)

    def counted(shared, end):
        def run(frames):
            for frame in frames:
                yield pd.DataFrame({"part": [0], "frame": [0], "n_ids": [int(frame["text"].str.len().sum())], "data": [b""]})

        return run

    monkeypatch.setattr(token_ids, "_frames", counted)
    token_ids.write(docs, str(tmp_path / "sizes"), public_tokenizers.path("word_bpe_49k.json"))
    largest = spark.read.parquet(str(tmp_path / "sizes")).agg(F.max("n_ids")).first()[0]
    assert largest <= 5 << 20 and spark.conf.get(BATCH_BYTES[0]) == BATCH_BYTES[1]


def test_many_texts_send_each_part_to_the_model_once(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        encoder = token_ids.Encoder(file.read())
    asked, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda parts: asked.extend(parts) or learn(parts))
    texts = [" Word, word WORD!! it's\x85x\n", None, "\t", "word% çà Été\x1fé 12²", "été <|pad|> İ Σς", "word it"]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert [ids.tolist() for ids in encoder.ids(texts)] == want
    assert len(asked) == len(set(asked)) and asked.count("word") == 1
    assert [ids.tolist() for ids in encoder.ids(texts[::-1])] == want[::-1] and asked.count("word") == 1
    monkeypatch.setattr(token_ids, "CACHED", 3)
    assert [[ids.tolist() for ids in encoder.ids([t])] for t in texts] == [[w] for w in want]  # a full memory starts anew


def test_frames_carry_their_own_order_0():
    ids = (np.random.default_rng(1).zipf(1.3, 200_000) % 3_000).astype("<u2")
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    frame = token_ids.pack([(1, True, ids[:25_000]), (2, True, ids[25_000:])])
    assert len(frame) * 8 / len(ids) < 1.2 * -(share * np.log2(share)).sum()
    assert (token_ids.unpack(frame)[1] == ids).all()


def test_shares_add_up_and_every_id_has_one():
    for ids in (np.zeros(1, np.uint16), np.arange(65_536, dtype=np.uint16), np.repeat(np.array([7, 9], np.uint16), [10**6, 1])):
        share = range_coder.shares(ids)
        assert share.sum() == 1 << 16 and (share[ids] > 0).all()
        coded = range_coder.encode([ids[:3000]], share)
        assert (range_coder.decode(coded, [len(ids[:3000])], share)[0] == ids[:3000]).all()


def test_coder_notices_a_changed_last_word():
    rng = np.random.default_rng(2)
    for _ in range(40):
        ids = rng.zipf(1.3, 300) % 500
        share = range_coder.shares(ids)
        coded = bytearray(range_coder.encode([ids], share)[0])
        coded[-1] ^= 1
        with pytest.raises(ValueError):
            range_coder.decode([bytes(coded)], [len(ids)], share)


def test_pieces_of_several_batches_are_tokenized_once(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        encoder = token_ids.Encoder(file.read())
    batches = [["One word, two words", None, "é 42"], [""], ["two words 中文", "three\x85words İ One"]]
    want = [[encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts] for texts in batches]
    frames = [pd.DataFrame({"doc_id": range(len(t)), "no_id": False, "text": t}) for t in batches]
    asked, pieces = [], encoder._pieces
    monkeypatch.setattr(encoder, "_pieces", lambda distinct: asked.append(distinct.to_pylist()) or pieces(distinct))

    def encoded():
        return [(list(keys["doc_id"]), [i.tolist() for i in ids]) for keys, ids in token_ids._encoded(iter(frames), encoder, 1)]

    assert encoded() == [(list(range(len(t))), w) for t, w in zip(batches, want, strict=True)]
    assert len(asked) == 1 and asked[0].count("words") == 1
    monkeypatch.setattr(token_ids, "GROUP", 1)
    monkeypatch.setattr(token_ids, "CACHED", 6)
    for _ in range(3):  # the memory is full now and then, and keeps what was used last
        assert encoded() == [(list(range(len(t))), w) for t, w in zip(batches, want, strict=True)]
    assert len(asked) == 1 + 3 * len(batches)


def test_coder_enters_what_it_saw_by_runs(monkeypatch):
    rng = np.random.default_rng(3)
    blocks = [rng.zipf(1.4, n) % 700 for n in (900, 0, 33, 32, 1, 700, 16)]
    share, runs, follow = range_coder.shares(np.concatenate(blocks)), [], range_coder._Model.follow
    monkeypatch.setattr(range_coder._Model, "follow", lambda self, *run: runs.append(run[1] - run[0]) or follow(self, *run))
    coded = range_coder.encode(blocks, share)
    assert runs == [16] * 56 + [4]
    assert [b.tolist() for b in range_coder.decode(coded, [len(b) for b in blocks], share)] == [b.tolist() for b in blocks]
    assert runs == ([16] * 56 + [4]) * 2
    assert [range_coder.encode([b], share)[0] for b in blocks] == coded  # each block stands alone
