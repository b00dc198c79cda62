"""Substring dedup: frames of bounded rows, few tables and files between its steps."""

import re
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pytest
from llm_rows import prose

from tidemark.llm import substring_dedup
from tidemark.llm.common import FRAME_ROWS


@pytest.fixture
def without_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_windows_of_a_long_text_leave_in_frames_of_bounded_rows():
    words = [f"w{i % 997}" for i in range(200_000)]
    blocks = [{"seed": 7, "first": 0, "last": 150_000}, {"seed": 8, "first": 150_001, "last": 199_950}]
    given = pd.DataFrame({"doc_id": [3], "text_key": [4], "text": [" ".join(words)], "blocks": [blocks]})
    frames = list(substring_dedup._windows(50)(iter([given])))
    assert max(map(len, frames)) <= FRAME_ROWS
    found = pd.concat(frames)
    assert found["first"].tolist() == found["last"].tolist() == list(range(199_951))
    assert (found["seed"] == np.where(found["first"] <= 150_000, 7, 8)).all() and found["words"].nunique() == 997


def test_blocks_leave_in_frames_of_bounded_rows():
    text = prose(5, 200_000)
    given = pd.DataFrame({"doc_id": range(12), "text_key": range(12), "text": [text] * 12})
    frames = list(substring_dedup._blocks(50, 20)(iter([given])))
    assert max(map(len, frames)) <= FRAME_ROWS
    found = pd.concat(frames)
    assert len(found) > FRAME_ROWS and found.groupby("doc_id").size().nunique() == 1
    assert ((found["first"].shift(-1) == found["last"] + 1) | (found["last"] == 199_950)).all()


def test_four_tables_between_without_checksum_files(spark, monkeypatch):
    docs = [(i, prose(0, 90) + " " + prose(1, 120) + " " + prose(i, 60 + i)) for i in range(2, 30)]
    kept, pin = [], substring_dedup.pin
    monkeypatch.setattr(substring_dedup, "pin", lambda df: kept.append(pin(df)) or kept[-1])
    found = substring_dedup.digest(substring_dedup.without_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == substring_dedup.brute_force(docs)
    assert len(kept) <= 4
    folders = {Path(urlparse(f).path).parent for table in kept for f in table.inputFiles()}
    assert folders and not [f for folder in folders for f in folder.iterdir() if f.suffix == ".crc"]


def test_joins_by_seed_deal_both_sides_anew(without_broadcasts, monkeypatch):
    """Only then Spark splits a hot seed."""
    tables, pin = [], substring_dedup.pin
    monkeypatch.setattr(substring_dedup, "pin", lambda df: tables.append(df) or pin(df))
    docs = [(i, prose(0, 80)) for i in range(4)]
    tables.append(substring_dedup.duplicate_spans(without_broadcasts.createDataFrame(docs, "doc_id long, text string")))
    joins = [t._jdf.queryExecution().executedPlan().toString() for t in tables]
    joins = [plan for plan in joins if re.search(r"SortMergeJoin \[seed", plan)]
    assert len(joins) == 3
    for plan in joins:
        assert len(re.findall(r"Sort \[seed.*\n.* Exchange hashpartitioning\(seed.*ENSURE_REQUIREMENTS", plan)) == 2
