"""Importance resampling, conversation repair and quality rules against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from compare import difference, plain
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import awkward_rows, prose
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair, importance, quality_rules
from tidemark.llm.queries import ORACLE, QUERIES

TURNS = "conv_id long, turn long, role string, text string"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_conversation_repair", "op13_quality_rules"])
def test_registered_query_equals_sql(spark, sf, name):
    assert difference(spark, name, QUERIES[name], ORACLE[name], sf) is None


# ---- importance resampling

@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBz09 -\n\x00É߀😀\x7f\x80"), max_size=60))
def test_windows_are_runs_of_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    pairs = importance.words_with_offsets(text)
    assert [w for w, _ in pairs] == words and all(lowered[a:b] == w for w, (a, b) in pairs)
    found = [b.tolist() for b in importance.window_buckets(pairs)]
    assert found == [[zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for i in range(len(words) - n + 1)] for n in (1, 2, 3)]


def _weights(docs, target):
    def features(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    S, T = float(sum(s.values())), float(sum(t.values()))
    out = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (S + 10_000) / ((s[b] + 1.0) * (T + 10_000)))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    return out


def test_importance_of_awkward_rows(spark, awkward, clashing):
    target = [prose(4, 60), "One TWO", None, ""]
    table = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(target)], "item_id long, text string, doc_id string")
    expected = _weights([(r[0], r[1]) for r in awkward_rows()], target)
    able = sorted((x for x in expected if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for docs in (awkward, clashing):
        found = rows(importance.importance(docs, table, percent=40).select("doc_id", "n_words", "n_features", "weight", "score", "rank"))
        assert sorted(map(plain, (r[:5] for r in found))) == sorted(map(plain, expected))
        drawn = sorted((r for r in found if r[5]), key=lambda r: r[5])
        assert [(r[0], r[4]) for r in drawn] == [(x[0], x[4]) for x in able[: 40 * len(able) // 100]]
        assert [r[5] for r in drawn] == list(range(1, len(drawn) + 1))
        kept = importance.resampled(docs, table, percent=40)
        assert kept.columns == docs.columns
        assert Counter(r[0] for r in kept.select("doc_id").collect()) == Counter(r[0] for r in drawn)


def test_importance_of_empty_tables(spark, awkward, no_documents):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert importance.importance(no_documents, empty).count() == 0 and importance.resampled(no_documents, empty).count() == 0
    assert importance.importance(awkward, empty).count() == len(awkward_rows())


def test_ranks_go_on_over_partitions(spark):
    scored = spark.range(20_000, numPartitions=7).select(
        F.col("id").alias("doc_id"), F.col("id").alias("key"), F.lit(20).cast("long").alias("n_words"), F.lit(1).cast("long").alias("n_features"),
        (F.xxhash64("id") % 50).alias("score"))
    found = importance.ranked(scored, percent=10)
    got = sorted((r["rank"], r["doc_id"]) for r in found.where("rank is not null").collect())
    every = sorted(((r["score"], r["doc_id"]) for r in scored.collect()), key=lambda x: (-x[0], x[1]))
    assert got == [(i + 1, doc) for i, (_, doc) in enumerate(every[:2000])]


# ---- conversation repair

def _all_repairs(letters):
    """(cost, audit, initials) of every way with up to two insertions at a place, by trying them all."""
    gaps = [(2 * len(g), "I" * len(g), g) for n in range(3) for g in map("".join, itertools.product("ua", repeat=n))]

    def edits(letter):
        late, role = letter.isupper(), letter.lower()
        yield 3, "D", ""
        if role != "x":
            yield int(late), "K", role
            yield from ((2 + late, "R", to) for to in "ua")

    def join(parts):
        return sum(p[0] for p in parts), "".join(p[1] for p in parts), "".join(p[2] for p in parts)

    for parts in itertools.product(*(x for letter in letters for x in (gaps, list(edits(letter)))), gaps):
        way = join(parts)
        if re.fullmatch("(s?(ua)+)?", way[2]):
            yield way


@pytest.mark.parametrize("letters", ["", *map("".join, itertools.product("suaoxUA", repeat=2)), "xuu", "aua", "sSa", "uaO", "aax", "ssu"])
def test_nodes_equal_all_repairs(letters):
    node = conversation_repair.ending(conversation_repair.FINAL)
    for letter in reversed(letters):
        node = conversation_repair.longer(letter, node)
    total, own, _, audit, made = node[0]
    assert (total, audit, made.replace("-", "")) == min(_all_repairs(letters)) and own == total


def test_suffixes_are_solved_once(monkeypatch):
    solved = Counter()
    step = conversation_repair.longer
    monkeypatch.setattr(conversation_repair, "longer", lambda letter, after: solved.update([letter]) or step(letter, after))
    signatures = sorted(s[::-1] for s in ("ua", "suaua", "uaua", "xuaua", "uaUa"))
    out = list(conversation_repair._solve(iter([pd.DataFrame({"end": ["end"] * 5, "backward": signatures})])))[0]
    assert sum(solved.values()) == len({s[: n + 1] for s in signatures for n in range(len(s))})
    assert dict(zip(out["backward"], (c[0] for c in out["costs"]))) == {"au": 0, "auau": 0, "auaus": 0, "auaux": 3, "aUau": 1}


def _conversations():
    rng = random.Random(5)
    made = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(1700)]  # longer than blocks
    made += [(2, rng.randrange(900), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", " ", "c!", "d? \n"])) for _ in range(1300)]
    for conv in range(3, 60):
        for turn in range(rng.randrange(1, 9)):
            made.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "system", None, "", "User"]),
                         rng.choice(["Same.", prose(conv * 10 + turn, 5) + ".", prose(turn, 3), "", None, "\t"])))
    made += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Yes."), (60, None, None, None), *[(61, 3, "user", "Again.")] * 5]
    return made


def _by_sql(made):
    con = duckdb.connect()
    frame = pd.DataFrame(made, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("frame", frame)
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM frame")
    return con.execute(ORACLE["op12_conversation_repair"]).fetchall()


def test_repairs_of_long_and_awkward_conversations(spark):
    made = _conversations()
    table = spark.createDataFrame(made, TURNS).repartition(5).withColumns({n: F.lit("clash") for n in ("place", "letter", "block", "fault", "state", "line")})
    found = rows(conversation_repair.audited(conversation_repair.damaged(table), table))
    assert sorted(map(plain, found)) == sorted(map(plain, _by_sql(made)))


def test_repaired_turns_follow_the_grammar(spark):
    table = spark.createDataFrame(_conversations(), TURNS)
    found = conversation_repair.repaired_turns(table).toPandas().sort_values(["conv_id", "turn"])
    for _, group in found.groupby("conv_id", dropna=False):
        assert re.fullmatch("s?(ua)+", "".join(r[0] for r in group["role"]))
        assert group["turn"].tolist() == list(range(1, len(group) + 1))
        assert set(group.loc[group["edit"] == "I", "text"]) <= {""}


def test_repairs_of_no_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_repair.audited(conversation_repair.damaged(empty), empty).count() == 0
    gone = spark.createDataFrame([(7, 1, "user", "x")], TURNS)
    assert rows(conversation_repair.audited(empty, gone)) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


# ---- quality rules

def _measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered))


def _text(rng, n, symbols):
    words = [w + ("#" if i < symbols else "") for i, w in enumerate(prose(rng.random(), n).split())]
    rng.shuffle(words)
    return " ".join(words)


def test_measures_and_verdicts_of_awkward_rows(spark, awkward, clashing):
    extra = [(90, "a b c a b c\nx\n \nx\nx", "en", "a", 1), (91, "é ß| 😀<", None, "a", 1), (92, "one two\x1cthree\x0bfour", "en", "a", 1)]
    for docs in (awkward, clashing):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars").unionAll(spark.createDataFrame(extra, awkward.schema))
        labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (2, 1, "x"), (None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")
        found = rows(quality_rules.verdicts(docs, labels).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept"))
        expected = []
        for doc_id, text, *_ in [*awkward_rows(), *extra]:
            m = _measures(text)
            bad = m[0] < 50 or 100 * m[5] > 50 * m[0]
            expected.append((doc_id, *m, bad, not bad))  # too few labels for any cutoff
        assert sorted(map(plain, found)) == sorted(map(plain, expected))


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 30, 500, 3000) for k in (0, 1, 2, 7, 29) if k <= n]
    table = spark.createDataFrame(cases, "k long, n long")
    for rate in (0.01, 0.2):
        for k, n, p in rows(table.select("k", "n", quality_rules.tail(F.col("k"), F.col("n"), rate))):
            exact = sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1)) if k < n * rate else 1.0
            assert p == pytest.approx(exact, rel=1e-9)
    large = spark.createDataFrame([(9_000, 1_000_000), (0, 10_000_000)], "k long, n long")
    assert [r[0] for r in rows(large.select(quality_rules.tail(F.col("k"), F.col("n"), 0.01)))] == [pytest.approx(0, abs=1e-20)] * 2


def test_cutoffs_hold_the_limit_per_stratum(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(2600):
        lang, junk = ("en", "de", "rare")[0 if i < 1200 else 1 if i < 2400 else 2], i % 6 == 0
        # German texts use symbols now and then, so the strictest cutoffs are not safe for them
        symbols = 30 if junk else rng.choice([0, 0, 0, 4]) if lang == "de" else 0
        docs.append((i, _text(rng, 60, symbols), lang))
        labels.append((i, 0 if junk else 1))
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality_rules.verdicts(table, marks).collect()}
    good = {lang: [i for (i, _, name), (_, q) in zip(docs, labels) if q and name == lang] for lang in ("en", "de", "rare")}
    junk = [i for i, q in labels if not q]
    for lang, ids in good.items():
        assert sum(not found[i]["kept"] for i in ids) <= quality_rules.LIMIT * len(quality_rules.RULES) * len(ids)
    assert all(found[i]["rejected_by"] == ["symbols"] for i in junk if docs[i][2] != "rare")
    assert all(found[i]["kept"] for i in junk if docs[i][2] == "rare")  # too few labels to promise anything
    kept = quality_rules.clean(table.withColumn("key", F.lit("clash")).withColumn("stratum", F.lit("clash")), marks)
    assert kept.columns == ["doc_id", "text", "lang", "key", "stratum"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["kept"]}


def test_copies_count_once_and_strata_are_corrected_for(spark):
    measure = (60, 300, 0, 1, 0, 0)

    def chosen(strata, n):
        table = spark.range(n).select(F.explode(F.array(*map(F.lit, strata))).alias("stratum"), *(
            F.lit(v).cast("long").alias(m) for m, v in zip(quality_rules.MEASURES, measure)))
        return {r["stratum"]: r["symbols"] for r in quality_rules.cutoffs(table).collect()}

    last, rules = len(quality_rules.RULES["symbols"][2]), len(quality_rules.RULES)
    enough = math.ceil(math.log(quality_rules.ERROR / rules) / math.log(1 - quality_rules.LIMIT))
    assert chosen(["a"], enough) == {"a": last} and chosen(["a"], enough - 1) == {"a": 0}
    assert chosen(["a", "b"], enough) == {"a": 0, "b": 0}  # two strata are twice as many tests
    docs = spark.createDataFrame([(i, prose(1, 60), "en") for i in range(1000)], "doc_id long, text string, lang string")
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    measured = quality_rules.measured(docs.withColumn("key", F.xxhash64("text")), "doc_id", F.col("lang").alias("stratum"), "key")
    assert quality_rules.good_texts(measured, labels).count() == 1


def test_quality_rules_of_empty_tables(spark, awkward, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.verdicts(no_documents, none).count() == 0
    assert quality_rules.verdicts(awkward, none).where("kept = base_failed").count() == 0
    assert quality_rules.clean(awkward, none).columns == awkward.columns
