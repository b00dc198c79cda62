import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import awkward_rows, prose

from tidemark.llm import jaccard_join, language_id, license_scan, line_dedup, lm_scoring, mixing, substring_dedup


def rows(df):
    return [tuple(r) for r in df.collect()]


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect() if r[0] is not None}


# ---- substring dedup

def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(7)
    texts = [prose(i, rng.randint(40, 400), "ab") for i in range(25)]
    for i in range(25, 60):  # passages of other texts between own words, runs of one word
        a, b = rng.sample(texts, 2)
        x, y = a.split(), b.split()
        texts.append(" ".join(x[rng.randint(0, 30):][: rng.randint(30, 120)] + prose(i, rng.randint(0, 20)).split()
                              + y[: rng.randint(45, 70)] + ["go"] * rng.choice([0, 60, 130])))
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for window, seed in ((50, 20), (12, 5)):
        got = by_id(substring_dedup.digest(substring_dedup.without_duplicates(df, window, seed)))
        assert got == substring_dedup.brute_force(docs, window)


def test_substring_dedup_awkward(clashing, no_documents):
    found = rows(substring_dedup.digest(substring_dedup.without_duplicates(clashing)))
    assert len(found) == len(awkward_rows())
    one = {r[0]: r for r in found}
    assert one[1][1:3] == (200, 0) and one[2][1:3] == (200, 200) and one[14][2] == 200
    assert one[3][1:3] == (200, 199) and one[17][2] == 0 and one[10][1:3] == (30_000, 0)
    assert one[13][1:3] == (200, 200) and one[6][1:] == (0, 0, hashlib.sha256(b"").hexdigest())
    assert [r[2] for r in found if r[0] is None] == [0, 0]
    assert rows(substring_dedup.without_duplicates(no_documents)) == []


# ---- near duplicates

def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [prose(i, rng.randint(3, 150)) for i in range(30)]
    for _ in range(90):
        words = rng.choice(texts).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", "z"])
        texts.append(" ".join(words))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert by_id(jaccard_join.similar_documents(df)) == jaccard_join.brute_force(docs)


def test_jaccard_join_cuts_large_sets_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    base, docs = prose(1, 300).split(), []
    for i in range(60):
        docs.append((i, " ".join([*base[:i], f"w{i}", *base[i + 1:]])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert by_id(jaccard_join.similar_documents(df)) == jaccard_join.brute_force(docs)


def test_jaccard_join_awkward(clashing, no_documents):
    found = rows(jaccard_join.similar_documents(clashing))
    assert len(found) == len(awkward_rows())
    one = {r[0]: r[1:] for r in found}
    assert one[1] == (1, 4) and one[2] == (1, 4) and one[3] == (1, 4) and one[14] == (1, 4)
    assert one[8] == one[9] == (8, 1) and one[12] == one[13] == (12, 1)
    assert one[5] == (5, 0) and one[6] == (6, 0) and one[None] == (None, 0)
    assert rows(jaccard_join.similar_documents(no_documents)) == []


def test_forest_shortens_prefixes_to_the_target():
    assert jaccard_join.matched_prefix(0.8, 20, 6, 0.9999) == 4
    assert jaccard_join.matched_prefix(0.8, 20, 6, 0.5) == 6
    assert jaccard_join.recall_at(4, 20, 0.8) > 0.9999


# ---- licences

def brute_licence(text):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    at = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words))
          if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))


def test_licences_equal_brute_force(spark):
    texts = ["Under the MIT license, under the mit license", "Apache License, Version 2.0; cc-by-nc CC BY NC!", "éunder the mit license",
             "under the\nMIT\tlicense.", "", None, "cc by nc by nc", "x" * 200_000 + " cc by nc", "under the mit licenses"]
    found = by_id(license_scan.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for at, text in enumerate(texts):
        assert found[at][:5] == brute_licence(text), text
        assert set(found[at][4].split(",")) <= set(found[at][5].split(",")) | {""}
        assert 0 <= found[at][6] <= 1


@pytest.mark.parametrize(("expression", "labels", "value"), [
    ("mit", ["mit"], 1.0), ("mit or gpl and agpl", ["mit", "gpl", "agpl"], 1.0), ("(mit or gpl) and agpl", ["mit", "gpl", "agpl"], 0.3),
    ("gpl with classpath-exception-2.0 or cc-by-nc", ["gpl with classpath-exception-2.0", "cc-by-nc"], 0.4),
    ("mit. see the file", ["mit"], 1.0), ("mit and", ["mit"], 1.0), ("((mit", ["mit"], 1.0), (")", [], None), ("", [], None),
    ("or mit", [], None), ("something-else", ["something-else"], 0.5),
])
def test_licence_expressions(expression, labels, value):
    assert license_scan.evaluate(expression) == (labels, value)


def test_tagged_expression_adds_labels():
    found = license_scan.scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC-BY-NC-4.0\ncode", license_scan.automaton())
    assert found[1] == 1 and found[5] == "apache-2.0,cc-by-nc,cc-by-nc-4.0,mit" and found[6] == 0.2


def test_every_tag_of_a_line_is_read():
    machine = license_scan.automaton()
    two = license_scan.scan("SPDX-License-Identifier: MIT */ code /* SPDX-License-Identifier: (AGPL OR GPL) AND MIT */", machine)
    assert two[5:] == ("agpl,gpl,mit", 0.4)
    cut = license_scan.scan("SPDX-License-Identifier: MIT OR SPDX-License-Identifier: SPDX-License-Identifier:GPL", machine)
    assert cut[5:] == ("gpl,mit", 0.4)
    words = license_scan.scan("spdx license identifiers: gpl; xspdx-license-identifier: agpl; spdx-license-identifier: mit", machine)
    assert words[5:] == ("mit", 1.0)
    many = license_scan.scan("SPDX-License-Identifier: MIT " * 20_000 + "SPDX-License-Identifier: ISC\nGPL", machine)
    assert many[5:] == ("isc,mit", 1.0)


def test_licences_awkward(clashing, no_documents):
    assert len(rows(license_scan.licenses(clashing))) == len(awkward_rows())
    assert rows(license_scan.licenses(no_documents)) == []


# ---- lines

def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [prose(i, 4) for i in range(40)]
    docs = [(i, "\n".join(rng.choices(pool[: rng.choice([5, 20, 40])], k=rng.randint(0, 12)) + [prose(1000 + i, 3), " "]),
             rng.choice(["a", "b", "c", "d", "e", "f", None])) for i in range(80)]
    docs += [(100, None, "a"), (101, "", "a")]
    for sites in (2, 4, 6):
        seen = {}
        for _, text, source in docs:
            for line in text.split("\n") if text is not None else []:
                seen.setdefault(line, set()).add(source)
        gone = {x for x, on in seen.items() if x.strip() and len(on - {None}) >= sites}
        want = {}
        for doc, text, _ in docs:
            lines = text.split("\n") if text is not None else []
            want[doc] = (len(lines), sum(x in gone for x in lines), "\n".join(x for x in lines if x not in gone))
        df = spark.createDataFrame(docs, "doc_id long, text string, source string")
        assert by_id(line_dedup.without_boilerplate(df, sites=sites)) == want


def test_line_dedup_awkward(clashing, no_documents):
    found = rows(line_dedup.without_boilerplate(clashing, sites=2))
    assert len(found) == len(awkward_rows())
    assert {r[0]: r for r in found}[2][1:] == (1, 1, "")
    assert rows(line_dedup.without_boilerplate(no_documents)) == []


# ---- language models

def test_lm_scores_equal_brute_force(spark, awkward):
    texts = [(i, prose(i % 20, 30 + i, "abc").upper() if i % 3 else prose(i, 20, "abc")) for i in range(100)] + [(200, None), (201, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    words = {d: (t or "").lower().split() + [None] for d, t in texts}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in texts}
    count = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    better = []
    for row in lm_scoring.scores(df).collect():
        ws = words[row.doc_id]
        assert row.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[row.doc_id], len(ws), sum(count[w] > 0 for w in ws), n)
        better.append(row.score - row.base_score)
        assert row.score <= 0
    assert sum(better) > 100


def test_lm_filter_reads_lower_bounds_and_stays_bounded(spark):
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 1 << 48, 4000, dtype=np.uint64))
    counts = (rng.pareto(1, len(grams)) * 2 + 2).astype(np.int64)
    rows_ = [("bigram", s, grams[part].tobytes(), counts[part].tobytes(), 0, 0, 0,
              np.bincount(lm_scoring.level_of(counts[part], 2), minlength=128).tolist())
             for s, part in lm_scoring._slices(grams, 3, 48)]
    schema = "kind string, segment int, grams binary, counts binary, n long, total long, ends long, levels array<long>"
    df = spark.createDataFrame(rows_, schema)
    whole = lm_scoring.bloom_filter(df, 3)
    read = whole.counts(grams)
    assert (read > 0).all() and whole.cutoff == 2
    assert (read > counts * 2**0.5).mean() < 0.05  # a chance hit of the next level
    assert (read >= counts / 2**0.5 - 1e-6).all()
    absent = np.setdiff1d(rng.integers(0, 1 << 48, 4000, dtype=np.uint64), grams)
    assert (whole.counts(absent) > 0).mean() < 0.05
    small = lm_scoring.bloom_filter(df, 3, max_bits=10_000)
    assert len(small.bits) * 8 <= 10_000 + 24 and small.cutoff > 2


def test_lm_bigrams_seen_once_count_and_segments_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SEGMENT_TOKENS", 300)
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 500)
    texts = {i: prose(i % 150, 60, "abc") for i in range(200)}
    words = {d: ["<", *t.split(), ">"] for d, t in texts.items()}
    learned = [ws for d, ws in words.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    one, two = Counter(w for ws in learned for w in ws), Counter(p for ws in learned for p in zip(ws, ws[1:], strict=False))
    assert sum(n == 1 for n in two.values()) > len(two) / 2
    scale = sum(one.values()) - len(learned) + 0.5 * len(one)
    over = []
    for row in lm_scoring.scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        want = 0.0
        for a, b in zip(words[row.doc_id], words[row.doc_id][1:], strict=False):
            held = 2 ** (math.floor(2 * math.log2(two[a, b]) + 1e-9) / 2) if two[a, b] else 0
            want += math.log10(0.4 * min(1, held / max(one[a], 1)) + 0.6 * (one[b] + 0.5) / scale)
        over.append((row.score - want) / row.n_tokens)
    assert min(over) > -1e-9 and np.mean(over) < 0.02 and np.mean(np.array(over) < 1e-9) > 0.1  # above: chance hits of the filter


def test_lm_awkward(clashing, no_documents):
    found = rows(lm_scoring.scores(clashing))
    assert len(found) == len(awkward_rows()) and all(math.isfinite(r[6]) for r in found)
    assert rows(lm_scoring.scores(no_documents)) == []


# ---- mixing

def test_mix_targets_and_copies(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 5000, None: 300}
    docs = [(i, prose(i, n // 10), s) for s, n in sizes.items() for i in range(10)]
    docs = [(k, t, s) for k, (_, t, s) in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    # filling step by step: sources that are full drop out, the rest is shared by weight again
    weight = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    rest, todo, target = 1.5 * sum(sizes.values()), dict(sizes), {}
    while True:
        level = rest / sum(weight[s] for s in todo)
        full = [s for s in todo if 2 * sizes[s] < level * weight[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            del todo[s]
    target |= {s: level * weight[s] for s in todo}
    found = mixing.taken(df).collect()
    source = {d: s for d, _, s in docs}
    for r in found:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
    assert rows(mixing.taken(df).orderBy("doc_id")) == sorted(tuple(r) for r in found)
    mixed = Counter(r[0] for r in rows(mixing.mix(df).select("doc_id")))
    assert all(mixed[r.doc_id] * r.size == r.taken for r in found)


def test_mix_awkward(spark, clashing, no_documents):
    found = rows(mixing.taken(clashing))
    assert len(found) == len(awkward_rows())
    assert all(r[4] <= 2 * r[1] for r in found)
    assert mixing.mix(clashing).columns == clashing.columns
    assert mixing.mix(clashing).where("size <> 'clash'").count() == 0
    assert rows(mixing.taken(no_documents)) == []
    none = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert sorted(rows(mixing.taken(none))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# ---- languages

def test_language_models_find_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language_id.identify(docs, language_id.fit(docs)).withColumn("held_out", language_id.held_out())
    held = found.where("held_out").select("lang", "lang_pred", "rejected").collect()
    assert sum(r[0] == r[1] for r in held) >= 0.95 * len(held)
    assert sum(r[2] for r in held) == 0


def test_language_probabilities_add_up(spark):
    docs = spark.createDataFrame([(i, prose(i, 60, "abcd"), "x") for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    letters = [*"abcd", " "]
    for context in ("abc", "a b", "dd ", "  a"):
        codes = [np.array([ord(c) for c in context + x], np.uint32) for x in letters]
        total = sum(2 ** model.total(c)[0] for c in codes)
        assert total <= 1.0001 and total > 0.7  # the rest is kept for characters never seen


def test_language_awkward(spark, clashing, no_documents):
    model = language_id.fit(clashing)
    found = language_id.identify(clashing, model).select("doc_id", "text", "lang_pred", "score", "rejected").collect()
    assert len(found) == len(awkward_rows())
    for r in found:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert r.lang_pred == "und" and r.score == 0 and r.rejected
        else:
            assert r.lang_pred in ("en", "de") and 0 < r.score <= 1
    nothing = language_id.fit(no_documents)
    assert {r[0] for r in language_id.identify(clashing, nothing).select("lang_pred").collect()} == {"und"}
    assert rows(language_id.identify(no_documents, model).select("doc_id")) == []


def test_language_rejects_foreign_scripts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    assert model.decide("Съешь же ещё этих мягких французских булок, да выпей чаю")[2]
    assert model.decide("qzx wvkj xqjz vvkq zzxj qqwx jxkz qvzx")[2]


def test_language_with_long_texts_only_is_learned(spark):
    texts = [(i, prose(i, 60, "abcde"), "short") for i in range(40)] + [(100 + i, prose(i, 6000, "vwxyz"), "long") for i in range(12)]
    docs = spark.createDataFrame([*texts, (300, "1 " * 30_000, "short")], "doc_id long, text string, lang string")
    assert min(len(t) for _, t, lang in texts if lang == "long") > language_id.SAMPLE_CHARS
    learned = [r["text"] for r in language_id.sample(docs).where("lang = 'long'").collect()]
    assert learned and all(len(t) == language_id.SAMPLE_CHARS + language_id.SAMPLE_PIECES - 1 for t in learned)
    found = language_id.identify(docs, language_id.fit(docs)).select("lang", "lang_pred", "rejected").where("doc_id < 300").collect()
    assert all(r[0] == r[1] and not r[2] for r in found)


def test_long_texts_are_scored_whole(monkeypatch, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    text = docs.where("length(text) > 3000").first()["text"]
    whole = model.decide(text)
    monkeypatch.setattr(language_id, "PIECE", 100)
    assert model.decide(text)[0] == whole[0] and model.decide(text)[3] == pytest.approx(whole[3])
