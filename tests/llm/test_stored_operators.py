import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from compare import difference
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import awkward_rows, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import decontaminate, jaccard_join, language_id, range_coder, token_ids, top_k
from tidemark.llm.queries import ORACLE, QUERIES

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- range coder and files

@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 65_535)), max_size=300), min_size=1, max_size=6))
def test_range_coder_round_trip(blocks):
    arrays = [np.array(b, np.int64) for b in blocks]
    coded = range_coder.encode(arrays)
    assert [d.tolist() for d in range_coder.decode(coded, [len(b) for b in blocks])] == blocks
    # a block does not depend on its neighbours
    assert range_coder.encode(arrays[:1])[0] == coded[0]


def test_range_coder_learns():
    ids = np.tile(np.arange(50), 60)
    assert len(range_coder.encode([ids])[0]) < 0.2 * len(ids)


def test_range_coder_long_block():
    ids = np.random.default_rng(0).zipf(1.2, 20_000) % 65_536
    assert (range_coder.decode(range_coder.encode([ids]), [len(ids)])[0] == ids).all()


def test_frames_notice_damage():
    frame = token_ids.pack([(5, True, np.arange(700, dtype="<u2")), (0, False, np.array([1], "<u2"))])
    docs, ids = token_ids.unpack(frame)
    assert docs["doc"].tolist() == [5, 0] and docs["n"].tolist() == [700, 1] and docs["has"].tolist() == [1, 0] and len(ids) == 701
    for at in (0, len(frame) - 20, len(frame) - 1):
        damaged = bytearray(frame)
        damaged[at] ^= 0x55
        with pytest.raises((ValueError, IndexError)):
            token_ids.unpack(bytes(damaged))
    with pytest.raises(ValueError):
        token_ids.unpack(frame[:-2])


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aB' \t\n1é̈ſΣ\x0b\x85 <|>")), max_size=40))
def test_encoder_equals_the_tokenizer(text):
    whole, pieces = _tokenizers()
    assert pieces.ids([text])[0].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]


def test_encoder_equals_a_tokenizer_whose_tokens_carry_the_space():
    file = VOCABULARY.replace("word_bpe_49k", "byte_bpe_50k")
    with open(file, encoding="utf-8") as described:
        whole, encoder = Tokenizer.from_file(file), token_ids.Encoder(described.read())
    texts = ["Hello world, it's  two\n\nlines ", "", None, " a", "a\tb <|endoftext|> c", "x" * 5000 + " y"]
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert ids.tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 1], text
    assert not encoder.alone and _tokenizers()[1].alone


_made = []


def _tokenizers():
    if not _made:
        with open(VOCABULARY, encoding="utf-8") as file:
            _made.extend([Tokenizer.from_file(VOCABULARY), token_ids.Encoder(file.read())])
    return _made


def brute_tokens(docs):
    whole, start, out = _tokenizers()[0], 0, []
    for doc, text in docs:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_ids_equal_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(token_ids, "FRAME", 5_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_tokens(docs.select("doc_id", "text").orderBy("doc_id").collect())
    assert sorted(rows(token_ids.written(docs, VOCABULARY))) == want


def test_token_ids_awkward(clashing, no_documents, tmp_path):
    found = rows(token_ids.written(clashing, VOCABULARY))
    assert len(found) == len(awkward_rows())
    starts = sorted((r[1], r[2], r[0]) for r in found)
    assert [s[0] for s in starts] == [sum(s[1] for s in starts[:i]) for i in range(len(starts))]
    assert [s[2] for s in starts][:2] == [None, None] and [s[2] for s in starts][2:] == sorted(r[0] for r in awkward_rows() if r[0])
    assert {r[0]: r[2] for r in found}[6] == 1
    assert rows(token_ids.written(no_documents, VOCABULARY)) == []
    token_ids.write(clashing, str(tmp_path / "ids"), VOCABULARY)
    texts = {r["doc_id"]: r["ids"] for r in token_ids.read(clashing.sparkSession, str(tmp_path / "ids")).collect()}
    assert texts[8] == [*_tokenizers()[0].encode("one two", add_special_tokens=False).ids, 1]


# ---- top-k

def brute_top_k(vectors, every, k):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in whole:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items()
                            if i != q and len(v) == len(whole[q]))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    for block, pack in ((8192, 256), (16, 3)):
        monkeypatch.setattr(top_k, "BLOCK", block)
        monkeypatch.setattr(top_k, "PACK", pack)
        vectors = [(i, [rng.choice([0.0, 0.25, -0.5, rng.gauss(0, 1)]) for _ in range(8)]) for i in range(150)]
        vectors += [(200 + i, [1.0] * 8) for i in range(12)] + [(300, [0.0] * 8), (310, [1e30] * 8), (315, [2.0, 1.0]), (316, [1.0, 3.0])]
        vectors = [(i, np.array(v, np.float32).tolist()) for i, v in vectors]
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").where("vec_id <> 310")
        want = brute_top_k([v for v in vectors if v[0] != 310], 5, 5)
        assert sorted(rows(top_k.top_k(df, F.col("vec_id") % 5 == 0))) == want


def test_top_k_awkward(spark):
    odd = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
           (5, [3.0, 1.0]), (5, [3.0, 1.0]), (6, []), (7, [3e38, 3e38]), (50, [-1.0, 0.0])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<float>").withColumns({"dim": F.lit("x"), "block": F.lit("x"), "v": F.lit(1)})
    found = sorted(rows(top_k.top_k(df, F.col("vec_id") % 50 == 0)))
    assert [r[:3] for r in found] == [(0, 1, 7), (0, 2, 5), (0, 3, 50), (50, 1, 0), (50, 2, 5), (50, 3, 7)]
    assert found[0][3] == 2**63 - 1 and found[5][3] == -(2**63)
    assert rows(top_k.top_k(df.limit(0), F.col("vec_id") % 50 == 0)) == []


# ---- benchmark items

def brute_contamination(docs, items, size=5, share=0.8):
    def sets(text, k):
        words = (text or "").encode().split()
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    out = {}
    for doc, text in docs:
        held = []
        for item, words in items:
            k = min(size, len((words or "").encode().split()))
            if k and len(sets(words, k) & sets(text, k)) >= share * len(sets(words, k)):
                held.append(item)
        out[doc] = (len(held), ",".join(map(str, sorted(held))))
    return out


def test_contamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, prose(500 + i, n)) for i, n in enumerate([1, 3, 5, 6, 9, 14, 20, 33, 60, 120, 400])]
    docs = []
    for i in range(150):
        words = prose(i, rng.choice([10, 300, 5000])).split()
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs.append((i, " ".join(words)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(docs, items)
    for block in (20_000, 4):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
        assert {r[0]: r[1:3] for r in rows(decontaminate.contamination(d, b))} == want
    left = {r[0] for r in rows(decontaminate.clean(d, b))}
    assert left == {doc for doc, found in want.items() if not found[0]} and len(left) > 20


def test_contamination_awkward(spark, clashing, no_documents):
    items = spark.createDataFrame([(1, prose(1, 200)), (2, None), (3, ""), (None, "one two"), (4, "one two"), (4, "one two"), (5, "x x x x x x x")],
                                  "item_id long, text string").withColumn("share", F.lit("x"))
    found = rows(decontaminate.contamination(clashing, items))
    assert len(found) == len(awkward_rows())
    one = {r[0]: r[1:3] for r in found}
    assert one[1] == one[2] == one[3] == (1, "1") and one[8] == (1, "4") and one[12] == (1, "5") and one[5] == one[6] == (0, "")
    assert sorted(r[2] for r in found if r[0] is None) == ["", "1"]
    clean = decontaminate.clean(clashing, items)
    assert clean.columns == clashing.columns and clean.count() == sum(r[1] == 0 for r in found)
    assert rows(decontaminate.contamination(no_documents, items)) == []
    assert {r[1] for r in rows(decontaminate.contamination(clashing, items.limit(0)))} == {0}


# ---- queries and pipeline

@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_their_oracle(spark, sf, name):
    assert difference(spark, name, QUERIES[name], ORACLE[name], sf) is None


def test_all_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if re.match(r"op\d+_", n))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_equal_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    before = {r["doc_id"]: r for r in docs.collect()}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(at)))
        out = spark.read.parquet(str(tmp_path / str(at)))
        assert out.columns == docs.columns, name
        after = [r.asDict() for r in out.collect()]
        assert all(before[r["doc_id"]].asDict() == r for r in after), name
        kept = {r["doc_id"] for r in after}
        texts = [(d, r["text"]) for d, r in before.items()]
        if at == 0:
            model = language_id.fit(docs)
            assert kept == {d for d, t in texts if not model.decide(t)[2]}
            assert len(kept) >= 0.99 * len(before)
        if at == 1:
            assert kept == {d for d, found in jaccard_join.brute_force(texts).items() if found[0] == d}
        if at == 2:
            assert kept == {d for d, found in brute_contamination(texts, items).items() if not found[0]}
        if at == 3:
            copies = Counter(r["doc_id"] for r in after)
            assert set(copies.values()) <= {1, 2}
        else:
            assert len(after) == len(kept)
            before = {d: before[d] for d in kept}
        docs = out
    want = brute_tokens([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])
    assert sorted(rows(corpus_pipeline.STAGES[4][1](spark, docs, sf))) == want
    assert sorted(rows(corpus_pipeline.run(spark, sf))) == want


def test_pipeline_awkward(spark, clashing, no_documents, sf):
    for start in (clashing, no_documents):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, sf)
            assert docs.columns == start.columns
        assert corpus_pipeline.STAGES[4][1](spark, docs, sf).count() == docs.count()
