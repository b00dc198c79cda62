"""Cheapest repairs of conversations whose turns are faulty or out of order, solved once per shared suffix.

Each turn becomes one letter: its role's initial, a capital if its text is cut off, ``x`` if it must go. A conversation's
letters are its signature. Signatures are sorted from their end, so equal suffixes stand together: a suffix is one
node of an automaton that all conversations share, and cost-to-go and least audit suffix of a node are computed once
for each of the grammar's four states, from the node that is one letter shorter.

Turns are sorted by ranges of (conversation, turn) and cut into blocks of 512 places, so a conversation of any length is
spread over tasks: it is cut into pieces, costs of all ways through each piece are composed from the end, states from
the start, by streaming over its few piece rows. Copies of a conversation share their signature's row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pin

BLOCK_BITS = 9
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
NOWHERE = 1 << 40
# states of (s?(ua)+)?: nothing yet, after s, after u, after a
STATES = range(4)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
ADDED = (2, 2, 3, 2)  # by an inserted or re-roled turn
ROLE = {2: "u", 3: "a"}
FINAL = "end"
WORD = r"[^\x20\x09-\x0D]"

Entry = tuple[int, int, int, str, str]  # cost to the end, cost of own edits, state at the end, audit, initials of the turns made
ENTRY = ("totals", "costs", "exits", "audits", "roles")
Node = list[Entry]


def ending(end: str) -> Node:
    """The node of the empty suffix: the conversation's end, or costs from each state on behind this piece."""
    if end == FINAL:
        return [(0, 0, 0, "", ""), (2 * INSERT, 2 * INSERT, 3, "II", "ua"), (INSERT, INSERT, 3, "I", "a"), (0, 0, 3, "", "")]
    return [(int(cost), 0, state, "", "") for state, cost in enumerate(end.split())]


def longer(letter: str, after: Node) -> Node:
    """The node of ``letter`` followed by the suffix of ``after``."""

    def edit(cost: int, name: str, role: str, then: Entry) -> Entry:
        return cost + then[0], cost + then[1], then[2], name + then[3], role + then[4]

    def best(ways: list[Entry]) -> Entry:  # a state has one way for each first letter, so the least letter decides ties
        return min(ways, key=lambda way: (way[0], way[3][0]))

    extra, plain = CUT_OFF if letter.isupper() else 0, letter.lower()
    node = []
    for state in STATES:
        ways = [edit(DELETE, "D", "-", after[state])]
        if plain != "x":
            ways.append(edit(REROLE + extra, "R", ROLE[ADDED[state]], after[ADDED[state]]))
            if state in KEPT[plain]:
                ways.append(edit(KEEP + extra, "K", plain, after[KEPT[plain][state]]))
        node.append(best(ways))
    # an insertion is worth at most one step between the states after u and after a, two before them
    node[2:] = [best([node[state], edit(INSERT, "I", ROLE[ADDED[state]], node[ADDED[state]])]) for state in (2, 3)]
    node[:2] = [best([node[state], edit(INSERT, "I", ROLE[2], node[2])]) for state in (0, 1)]
    return node


def _solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (end, reversed signature): nodes of the suffix shared with the row before are still there."""
    end, backward, nodes = None, "", []
    for frame in frames:
        out = []
        for this_end, this in zip(frame["end"], frame["backward"]):
            shared = 0
            if this_end != end:
                nodes = [ending(this_end)]
            else:
                while shared < min(len(this), len(backward)) and this[shared] == backward[shared]:
                    shared += 1
            del nodes[shared + 1 :]
            for letter in this[shared:]:
                nodes.append(longer(letter, nodes[-1]))
            end, backward = this_end, this
            out.append([[entry[at] for entry in nodes[-1]] for at in range(len(ENTRY))])
        yield frame.assign(**{name: [row[at] for row in out] for at, name in enumerate(ENTRY)})


def solved(pieces: DataFrame) -> DataFrame:
    """(end, signature, totals, costs, exits, audits, roles) of every distinct signature and end, by state at its start."""
    distinct = pieces.select("end", F.reverse("signature").alias("backward")).distinct()
    order = ["end", "backward"]
    found = distinct.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        _solve, "end string, backward string, totals array<long>, costs array<long>, exits array<int>, audits array<string>, roles array<string>")
    return pin(found.withColumn("signature", F.reverse("backward")).drop("backward"))


def _backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ends of pieces, last piece first: costs from each state on behind the piece, less the least of them."""
    conversation, costs = None, []
    for frame in frames:
        ends = []
        for name, ways in zip(frame["conversation"], frame["ways"]):
            if name != conversation:
                conversation, ends_here, costs = name, FINAL, [entry[0] for entry in ending(FINAL)]
            else:
                least = min(costs)
                costs = [cost - least for cost in costs]
                ends_here = " ".join(map(str, costs))
            ends.append(ends_here)
            costs = [min(min(ways[out]["totals"][state] + costs[out], NOWHERE) for out in STATES) for state in STATES]
        yield frame[["conversation", "block"]].assign(end=ends)


def _forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """State at the start of each piece, first piece first."""
    conversation, state = None, 0
    for frame in frames:
        starts = []
        for name, exits in zip(frame["conversation"], frame["exits"]):
            state = state if name == conversation else 0
            conversation = name
            starts.append(state)
            state = int(exits[state])
        yield frame[["conversation", "block"]].assign(state=starts)


def conversation_key(conversation: str | Column = "conv_id") -> Column:
    """Text for any conv_id, so that a null one is a conversation as well."""
    return F.coalesce(F.concat(F.lit("="), F.col(conversation).cast("string")), F.lit(""))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, cut off, repeated or given to the user by the crc32 of their place."""
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    plain = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(place) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return plain.where("fault != 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")


def turns(rows: DataFrame) -> DataFrame:
    """The rows in order, stored with place, block, fault and letter: by turn (null first), then role and text.

    ``place`` counts rows in this order over all conversations; those of a conversation in one block follow one another.
    """
    plain = rows.select(
        conversation_key().alias("conversation"), "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")),
        F.monotonically_increasing_id().alias("row"))
    order = ["conversation", F.asc_nulls_first("turn"), "role", "text", "row"]
    placed = pin(plain.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("place", F.monotonically_increasing_id()))
    same = ["conversation", F.xxhash64("role", "text"), F.xxhash64(F.lit(7), "role", "text")]
    first = placed.groupBy(*same).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    marked = placed.join(first, "place", "left")
    fault = (F.when(~F.col("text").rlike(WORD), "blank").when(F.col("first").isNull(), "duplicate")
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated"))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return pin(marked.select(
        "conversation", "turn", "role", "text", "place", F.shiftright("place", BLOCK_BITS).alias("block"),
        fault.alias("fault"), known.alias("initial")).withColumn("letter", letter))


def _pieces(placed: DataFrame) -> DataFrame:
    """One row for the turns that a conversation has in one block."""
    row = F.struct("place", "letter", "initial")
    grouped = placed.groupBy("conversation", "block").agg(
        F.sort_array(F.collect_list(row)).alias("rows"), F.min("place").alias("start"), F.min("turn").alias("least"), F.max("turn").alias("most"),
        F.size(F.collect_set("turn")).alias("n_turns"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))

    def joined(name: str) -> Column:
        return F.array_join(F.transform("rows", lambda r: r[name]), "")

    named = grouped.withColumns({"signature": joined("letter"), "initials": joined("initial")}).drop("rows")
    every = Window.partitionBy("conversation").orderBy("block")
    legal = F.regexp_count("initials", F.lit("(?=su|ua|au)"))
    seam = F.concat(F.lag(F.substring("initials", -1, 1)).over(every), F.substring("initials", 1, 1))
    return pin(named.select(
        "conversation", "block", "start", "least", "most", "signature", "blank", "duplicate", "truncated",
        (F.col("n_turns") - F.coalesce((F.lag("most").over(every) == F.col("least")).cast("int"), F.lit(0))).alias("n_turns"),
        (F.length("initials") - 1 - legal + F.coalesce((~seam.isin("su", "ua", "au")).cast("int"), F.lit(0))).alias("illegal"),
        (F.lag("block").over(every).isNull() & F.lead("block").over(every).isNull()).alias("whole")))


def repairs(placed: DataFrame) -> DataFrame:
    """One row a piece, with its state at the start, own cost, audit and the initials of the turns that its edits make."""
    pieces = _pieces(placed)
    several = pieces.where("not whole")
    order = ["conversation", F.desc("block")]
    units = [" ".join(str(0 if out == state else NOWHERE) for state in STATES) for out in STATES]
    asked = several.select("conversation", "block", "signature", F.explode(F.array(*map(F.lit, units))).alias("end"))
    ways = asked.join(solved(asked), ["signature", "end"]).groupBy("conversation", "block").agg(
        F.sort_array(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, units)), F.col("end")).alias("out"), "totals"))).alias("ways"))
    ends = pin(ways.repartition("conversation").sortWithinPartitions(*order).mapInPandas(_backward, "conversation string, block long, end string"))
    ended = several.join(ends, ["conversation", "block"]).unionByName(pieces.where("whole").withColumn("end", F.lit(FINAL)))
    found = pin(ended.join(solved(ended), ["signature", "end"]))
    states = pin(found.where("not whole").select("conversation", "block", "exits").repartition("conversation")
                 .sortWithinPartitions("conversation", "block").mapInPandas(_forward, "conversation string, block long, state int"))
    every = found.join(states, ["conversation", "block"], "left").withColumn("state", F.coalesce("state", F.lit(0)))
    own = {name: F.get(F.col(many), F.col("state")) for name, many in (("cost", "costs"), ("audit", "audits"), ("made", "roles"))}
    return pin(every.withColumns(own).drop(*ENTRY, "end", "whole"))


def repaired(placed: DataFrame, found: DataFrame) -> DataFrame:
    """(conversation, block, at, edit, role, text): the turns of the repaired conversations, in order of block and at."""
    each = found.select("conversation", "block", "start", "audit", "made", F.explode(F.sequence(F.lit(1), F.length("audit"))).alias("at")).where(
        F.length("audit") > 0)
    before = F.length(F.translate(F.substring("audit", F.lit(1), F.col("at") - 1), "I", ""))
    steps = each.select(
        "conversation", "block", "at", F.substring("audit", F.col("at"), F.lit(1)).alias("edit"), F.substring("made", F.col("at"), F.lit(1)).alias("made"),
        (F.col("start") + before).alias("place"))
    role = F.when(F.col("made") == "u", "user").otherwise("assistant")
    inserted = steps.where("edit = 'I'").select("conversation", "block", "at", "edit", role.alias("role"), F.lit("").alias("text"))
    stayed = steps.where("edit in ('K', 'R')").join(placed.select("place", F.col("role").alias("own"), "text"), "place").select(
        "conversation", "block", "at", "edit", F.when(F.col("edit") == "K", F.col("own")).otherwise(role).alias("role"), "text")
    return inserted.unionByName(stayed)


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """sha256 of each conversation's lines, which come in order; nothing but the running digest is kept."""
    conversation, digest = None, None
    for frame in frames:
        out = []
        for name, line in zip(frame["conversation"], frame["line"]):
            if name != conversation:
                if digest:
                    out.append((conversation, digest.hexdigest()))
                conversation, digest = name, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode())
        yield pd.DataFrame(out, columns=["conversation", "repaired_sha256"])
    if digest:
        yield pd.DataFrame({"conversation": [conversation], "repaired_sha256": [digest.hexdigest()]})


def audited(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row a conversation.

    A conv_id of ``conversations`` (those of ``rows`` if not given) without rows has zeros, an empty audit and the hash of
    nothing. Null conv_ids are one conversation, null turns come first, null roles and texts are one space. Turns of equal
    number are taken by role and text, so repeated rows stand side by side; initials other than s, u and a can only be
    given a role or deleted. Other columns play no part. The hash runs over a conversation's turns one after
    another, as it must, in one task that keeps none of them.
    """
    placed = turns(rows)
    found = repairs(placed)
    line = F.concat("role", F.lit(":"), "text")
    order = ["conversation", "block", "at"]
    lines = repaired(placed, found).select(*order, line.alias("line")).repartition("conversation").sortWithinPartitions(*order)
    hashes = lines.mapInPandas(_hashed, "conversation string, repaired_sha256 string")
    in_order = F.sort_array(F.collect_list(F.struct("block", "audit")))
    per = found.groupBy("conversation").agg(
        (F.max("most") - F.min("least") + 1 - F.sum("n_turns")).alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(F.transform(in_order, lambda piece: piece["audit"]), "").alias("audit"))
    every = (rows if conversations is None else conversations).select("conv_id").distinct().withColumn("conversation", conversation_key())
    joined = every.join(per, "conversation", "left").join(hashes, "conversation", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, edit): the repaired conversations, turns numbered from 1, ``edit`` K, R or I."""
    placed = turns(rows)
    lines = pin(repaired(placed, repairs(placed)))
    # numbers go on from block to block; a block has few rows of a conversation, a conversation few blocks
    sizes = lines.groupBy("conversation", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conversation").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conversation", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conversation", "block").orderBy("at"))
    numbered = lines.withColumn("inside", inside).join(starts, ["conversation", "block"])
    ids = rows.select("conv_id").distinct().withColumn("conversation", conversation_key())
    return numbered.join(ids, "conversation").select(
        "conv_id", (F.col("before") + F.col("inside")).cast("long").alias("turn"), "role", "text", "edit")


def _oracle() -> str:
    def then(cost: str, name: str, state: int, made: str = "") -> str:
        line = f"list_concat([{made}], s{state}.r)" if made else f"s{state}.r"
        return f"{{'c': {cost} + s{state}.c, 'a': '{name}' || s{state}.a, 'r': {line}}}"

    def never(condition: str, way: str) -> str:
        return f"CASE WHEN {condition} THEN {way} ELSE {{'c': {NOWHERE}, 'a': '', 'r': []::VARCHAR[]}} END"

    role, extra = {2: "'user:'", 3: "'assistant:'"}, f"(t.fault = 'truncated')::INT * {CUT_OFF}"
    rows = []
    for state in STATES:
        to = ADDED[state]
        ways = [then(str(DELETE), "D", state), never("t.stays", then(f"{REROLE} + {extra}", "R", to, f"{role[to]} || t.text"))]
        ways += [never(f"t.stays AND t.initial = '{i}'", then(extra, "K", go[state], "t.role || ':' || t.text"))
                 for i, go in KEPT.items() if state in go]
        rows.append(f"list_min([{', '.join(ways)}]) AS b{state}")

    def added(of: str, to: str, state: int) -> str:
        return f"list_min([{of}, {{'c': {INSERT} + {to}.c, 'a': 'I' || {to}.a, 'r': list_concat([{role[state]}], {to}.r)}}])"

    return rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS step
), k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h
  FROM conversations
), f AS (
  SELECT k.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i+1])::BIGINT)),
           lambda a, x: xor(a >> 8, step[xor(a & 255, x) + 1])), 4294967295) % 20 AS f
  FROM k, crc
), d AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM f WHERE f <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
  FROM n
), t AS (
  SELECT *, role[1] AS initial, coalesce(fault NOT IN ('blank', 'duplicate'), true) AS stays FROM (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
    FROM o)
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM t GROUP BY conv_id
), r AS (
  SELECT conv_id, n AS i, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS s0,
         {{'c': {2 * INSERT}::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']}} AS s1,
         {{'c': {INSERT}::BIGINT, 'a': 'I', 'r': ['assistant:']}} AS s2, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS s3
  FROM s
  UNION ALL
  SELECT conv_id, i, {added('b0', 's2', 2)}, {added('b1', 's2', 2)}, s2, s3 FROM (
    SELECT conv_id, i, b0, b1, {added('b2', 'b3', 3)} AS s2, {added('b3', 'b2', 2)} AS s3 FROM (
      SELECT r.conv_id, r.i - 1 AS i, {', '.join(rows)}
      FROM r JOIN t ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i))
), best AS (SELECT conv_id, s0 FROM r WHERE i = 0),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit,
       sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN s ON ids.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id
"""


ORACLE = _oracle()
