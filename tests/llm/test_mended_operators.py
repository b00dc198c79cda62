"""Results that were wrong once: licence tags and prose, sources without doc_ids."""

import pytest
from llm_rows import prose

from tidemark.llm import license_scan, mixing

MACHINE = license_scan.automaton()
TAG = "SPDX-License-Identifier:"


@pytest.mark.parametrize("text, labels, score", [
    (f"{TAG}\n\nprint('x')", "", 0.0),
    (f"{TAG} see the file", "", 0.0),
    (f"# {TAG} TODO", "", 0.0),
    (f"{TAG} Apache-2.0 and copyright 2020 foo", "apache-2.0", 1.0),
    (f"{TAG} MIT\r\n", "mit", 1.0),
    (f"{TAG} GPL-2.0-only", "gpl-2.0-only", 0.4),
    (f"{TAG} GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl-2.0-or-later with classpath-exception-2.0", 0.4),
    (f"{TAG} LGPL-2.1+", "lgpl-2.1+", 0.6),
    (f"{TAG} (MIT OR AGPL-3.0-only) AND ISC", "agpl-3.0-only,isc,mit", 1.0),
    (f"{TAG} LicenseRef-Own-Terms", "licenseref-own-terms", 0.5),
])
def test_tags_are_read_on_their_line_as_ids(text, labels, score):
    assert license_scan.scan(text, MACHINE)[5:] == (labels, score)


def test_sources_without_doc_ids_come_near_their_targets(spark):
    rows = [(None, prose(i, 20), source) for i in range(400) for source in "ab"] + [(i, prose(i, 20), "c") for i in range(400)]
    found = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in (1, 2):
        some = [r for r in found if (r["doc_id"] is None) == (source == 1)]
        targets = {r["target"] for r in some}
        assert sum(r["taken"] for r in some) == pytest.approx(sum(targets) if source == 2 else sum(targets), rel=0.15)
    assert all(r["taken"] <= 2 * r["size"] for r in found)
