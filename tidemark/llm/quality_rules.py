"""Quality rules whose cutoffs are chosen from labelled documents at a controlled risk, with DataFrame functions only.

Every rule has a fixed list of cutoffs from mild to strict. For each stratum (language) and rule the labelled good texts
that a cutoff would reject are counted, and the exact binomial tail says how likely so few are if the cutoff's true
false rejection rate were at the limit. Cutoffs are tested in order and testing stops at the first that is not significant;
the levels of the strata's and rules' sequences add up to ``ERROR`` (Bonferroni). So with a probability of at least
1 - ``ERROR`` no cutoff in use, in any stratum, rejects more than ``LIMIT`` of good documents.

Measures are taken row by row, without a shuffle. Labels are joined to narrow rows; counts per stratum, rule and
cutoff are aggregated before the shuffle, and the few chosen cutoffs are joined back by stratum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import evaluated_once
from tidemark.llm.common import pin, text_key

LIMIT = 0.01  # of the good documents of a stratum, for each rule
ERROR = 0.05
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
WINDOW = 3
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
# rule: measure, what it is divided by, cutoffs in thousandths from mild to strict
RULES = {
    "symbols": ("n_symbols", "n_words", (1000, 700, 500, 400, 300, 200, 150, 100, 70, 50, 30, 20, 10, 5, 2)),
    "dup_lines": ("n_dup_lines", "n_lines", (900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 200, 150, 100)),
    "repeats": ("n_repeat_words", "n_words", (450, 400, 350, 300, 250, 200, 150, 100, 70, 50)),
    "word_length": ("word_chars", "n_words", (20_000, 15_000, 12_000, 10_000, 9_000, 8_500, 8_000, 7_500, 7_000, 6_500)),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated(hashes: Column, window: int = WINDOW) -> Column:
    """Number of places covered by windows whose hash is there twice or more."""

    def covered(s: Column) -> Column:
        def twin(e: Column, at: Column) -> Column:
            return (F.get(s, at - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, at + 1)["h"].eqNullSafe(e["h"]))

        places = F.transform(F.filter(s, twin), lambda e: F.sequence(e["at"], e["at"] + (window - 1)))
        return F.size(F.array_distinct(F.flatten(places)))

    placed = F.transform(hashes, lambda h, at: F.struct(h.alias("h"), at.alias("at")))
    # texts without a repeated window, which are most, are not sorted
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(F.sort_array(placed), covered))


def measured(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` of ``docs`` and the measures of every whole text; a null text has no words and no lines."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        *columns, F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    names = [c for c in rows.columns if c not in ("_words", "_lines", "n_symbols")]
    n = F.size("_words")
    hashes = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
        lambda at: F.xxhash64(*(F.get(F.col("_words"), at + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    split = rows.select(*names, "n_symbols", evaluated_once(F.col("_words")).alias("_words"), evaluated_once(F.col("_lines")).alias("_lines"))
    counted = split.select(
        *names, n.cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), evaluated_once(hashes).alias("_hashes"))
    return counted.withColumn("n_repeat_words", _repeated(F.col("_hashes")).cast("long")).drop("_hashes")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def mildest(rule: str) -> Column:
    """Place, from 1, of the mildest of the rule's cutoffs that rejects the row, as all later ones do; past the end if none does."""
    part, whole, cutoffs = RULES[rule]
    return F.lit(len(cutoffs) + 1) - sum((1000 * F.col(part) > c * F.col(whole)).cast("int") for c in cutoffs)


def tail(k: Column, n: Column, rate: float) -> Column:
    """P(at most ``k`` of ``n``) of a binomial of this rate, for k below n * rate; otherwise 1.

    The last term is taken from sums of logarithms, the others from their ratio to the one above, so that nothing runs
    over or under.
    """
    ways = F.when(k > 0, F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.lit(0.0),
        lambda total, j: total + F.log((n - k + j) / j))).otherwise(F.lit(0.0))
    last = F.exp(ways + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1 - rate)))

    def lower(state: Column, i: Column) -> Column:
        term = state["term"] * i / (n - i + 1) * F.lit((1 - rate) / rate)
        return F.struct((state["total"] + term).alias("total"), term.alias("term"))

    start = F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("term"))
    terms = F.when(k > 0, F.aggregate(
        F.sequence(F.greatest(k, F.lit(1)), F.lit(1).cast("long"), F.lit(-1).cast("long")), start, lower)["total"]).otherwise(F.lit(1.0))
    return F.when(k < n * F.lit(rate), F.least(last * terms, F.lit(1.0))).otherwise(F.lit(1.0))


def cutoffs(good: DataFrame, limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """(stratum, <rule>...): for each stratum the place of every rule's chosen cutoff, from 1; 0 where none is safe.

    ``good`` holds one row (stratum, measures) for each good text. Texts that fail the base rules play no part.
    """
    passed = good.where(~base_failed()).select("stratum", *(mildest(r).alias(r) for r in RULES))
    rows = passed.select("stratum", F.explode(F.array(
        *(F.struct(F.lit(r).alias("rule"), F.col(r).alias("mildest"), F.lit(len(RULES[r][2])).alias("last")) for r in RULES))).alias("x"))
    counts = pin(rows.select("stratum", "x.*").groupBy("stratum", "rule", "mildest", "last").agg(F.count("*").alias("n")))
    totals = counts.groupBy("stratum", "rule").agg(F.sum("n").alias("n"))
    # a cutoff rejects what any milder one does
    steps = counts.where("mildest <= last").select("stratum", "rule", F.explode(F.sequence("mildest", "last")).alias("at"), "n").groupBy(
        "stratum", "rule", "at").agg(F.sum("n").alias("k"))
    grid = counts.select("stratum").distinct().select("stratum", F.explode(F.array(
        *(F.struct(F.lit(r).alias("rule"), F.lit(at).alias("at")) for r in RULES for at in range(1, len(RULES[r][2]) + 1)))).alias("x"))
    grid = grid.select(F.col("stratum").alias("_stratum"), F.col("x.rule").alias("_rule"), F.col("x.at").alias("at"))
    met = grid.join(totals, F.col("_stratum").eqNullSafe(F.col("stratum")) & (F.col("_rule") == F.col("rule"))).select(
        "_stratum", "_rule", F.col("at").alias("_at"), "n")
    met = met.join(steps, F.col("_stratum").eqNullSafe(F.col("stratum")) & (F.col("_rule") == F.col("rule")) & (F.col("_at") == F.col("at")), "left")
    sequences = pin(counts.select("stratum").distinct()).count() * len(RULES)
    tested = met.select("_stratum", "_rule", "_at", F.coalesce("k", F.lit(0)).cast("long").alias("k"), "n")
    safe = tail(F.col("k"), F.col("n"), limit) <= F.lit(error / max(sequences, 1))
    first = F.min(F.when(~F.col("safe"), F.col("_at")))
    chosen = tested.withColumn("safe", safe).groupBy(F.col("_stratum").alias("stratum"), "_rule").agg(
        (F.coalesce(first, F.max("_at") + 1) - 1).alias("chosen"))
    return chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("_rule") == r, F.col("chosen"))).alias(r) for r in RULES))


def good_texts(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, measures) of the texts labelled as good, each text of a stratum once.

    A doc_id is good if all its labels have quality 1; equal texts are one observation, as the binomial needs.
    """
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality")).where("quality = 1").select("doc_id")
    return measures.join(good, "doc_id").select("key", "stratum", *MEASURES).distinct().drop("key")


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """(doc_id, key, stratum, measures, base_failed, kept, rejected_by): one row per row of ``docs``, ``key`` a hash of its text.

    A text is rejected if it fails the base rules or lies beyond the cutoff that its stratum has for any rule;
    ``rejected_by`` names these rules. A null stratum is one of its own. Strata without enough good labelled texts, and
    tables without labels, have no cutoffs, and only the base rules reject there. A null or empty text has no words and
    fails the base rules. Rows that repeat a doc_id are judged each for itself; rows without one are judged but never
    labelled. Other columns play no part.
    """
    rows = docs.select("doc_id", F.col(stratum).alias("stratum"), text_key().alias("key"), "text")
    measures = pin(measured(rows, "doc_id", "stratum", "key"))
    chosen = pin(cutoffs(good_texts(measures, labels.select("doc_id", "quality")), limit, error).withColumnRenamed("stratum", "_stratum"))
    joined = measures.join(chosen, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    beyond = [F.when(mildest(r) <= F.col(r), F.lit(r)) for r in RULES]
    by = F.array_compact(F.array(*beyond))
    return joined.select(
        "doc_id", "key", "stratum", *MEASURES, base_failed().alias("base_failed"), (~base_failed() & (F.size(by) == 0)).alias("kept"),
        by.alias("rejected_by"))


def clean(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, whatever their names."""
    rows = docs.select("doc_id", F.col(stratum).alias("stratum"), text_key().alias("key"), F.struct("*").alias("row"))
    kept = verdicts(docs, labels, stratum, limit, error).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("stratum").alias("_stratum"), F.col("key").alias("_key")).distinct()
    same = (F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("stratum").eqNullSafe(F.col("_stratum")) & F.col("key").eqNullSafe(F.col("_key")))
    return rows.join(kept, same, "left_semi").select("row.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(m for m in MEASURES if m != "n_lines"), "base_failed", "kept")


def _oracle() -> str:
    grid = ", ".join(f"{{'rule': '{r}', 'cuts': {list(RULES[r][2])}}}" for r in RULES)
    part = "CASE rule " + " ".join(f"WHEN '{r}' THEN {RULES[r][0]}" for r in RULES) + " END"
    whole = "CASE rule " + " ".join(f"WHEN '{r}' THEN {RULES[r][1]}" for r in RULES) + " END"
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS id, doc_id, lang AS stratum, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS three FROM t
), r AS (
  SELECT id, count(DISTINCT place) AS n FROM (
    SELECT id, unnest([i, i + 1, i + 2]) AS place FROM (SELECT *, count(*) OVER (PARTITION BY id, three) AS times FROM g) WHERE times > 1
  ) GROUP BY id
), m AS (
  SELECT id, doc_id, stratum, text, len(w) AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words
  FROM t LEFT JOIN r USING (id)
), b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
rules AS (SELECT unnest([{grid}], recursive := true)),
good AS (
  SELECT DISTINCT text, stratum, {", ".join(MEASURES)} FROM b
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1)
), n AS (SELECT stratum, count(*) AS n FROM good GROUP BY stratum),
k AS (
  SELECT n.stratum, rule, place, cuts[place] AS cut, any_value(n.n) AS n, count(*) FILTER (WHERE 1000 * {part} > cuts[place] * {whole}) AS k
  FROM n JOIN good ON n.stratum IS NOT DISTINCT FROM good.stratum, (SELECT rule, cuts, unnest(range(1, len(cuts) + 1)) AS place FROM rules) GROUP BY ALL
), p AS (
  SELECT *, CASE WHEN k < n * {LIMIT}::DOUBLE THEN list_sum(list_transform(range(k + 1), lambda i: exp(
           lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({LIMIT}::DOUBLE) + (n - i) * ln(1 - {LIMIT}::DOUBLE)))) ELSE 1 END AS p
  FROM k
), c AS (
  SELECT stratum, rule, arg_max(cut, place) FILTER (WHERE good) AS cut FROM (
    SELECT *, bool_and(p <= {ERROR}::DOUBLE / ({len(RULES)} * (SELECT count(*) FROM n))) OVER (PARTITION BY stratum, rule ORDER BY place) AS good FROM p
  ) GROUP BY stratum, rule
), bad AS (
  SELECT DISTINCT id FROM b JOIN c ON b.stratum IS NOT DISTINCT FROM c.stratum WHERE 1000 * {part} > cut * {whole}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.id IS NULL AS kept
FROM b LEFT JOIN bad USING (id)
"""


ORACLE = _oracle()
