"""License scans: Aho-Corasick over words, and a shunting-yard evaluation of licence expressions.

A text is lower-cased (A-Z only) and reduced to its words, joined by single spaces. One automaton finds, in a single
pass, the base phrases, further notice phrases and the identifier tag. At every place of the tag, the expression after it,
up to the end of its line or the next tag, is read from the text itself, turned into postfix order and evaluated. The automaton is a few dozen fixed strings; every
text is handled on its own, so the job is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm.common import chunks, with_own_id, with_plain_id

# The base phrases and their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notices, as words
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "all-rights-reserved",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
TAG = "spdx license identifier"
# How freely text under a label may be reused, 0 to 1; of other labels, half
GRADES = {
    "mit": 1.0, "apache-2": 1.0, "apache-2.0": 1.0, "bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0,
    "unlicense": 1.0, "cc0-1.0": 1.0, "cc-by": 0.9, "cc-by-4.0": 0.9, "mpl": 0.7, "mpl-2.0": 0.7, "lgpl": 0.6, "gpl": 0.4,
    "agpl": 0.3, "cc-by-nc": 0.2, "cc-by-nc-4.0": 0.2, "all-rights-reserved": 0.0,
}
UNKNOWN_GRADE = 0.5
_BINDING = {"or": 1, "and": 2, "with": 3}
# Licence ids of the public list that have neither a digit nor a hyphen (fixed values)
PLAIN_IDS = frozenset((
    "mit", "isc", "zlib", "unlicense", "wtfpl", "ncsa", "beerware", "postgresql", "openssl", "ruby", "curl", "libpng", "json", "intel",
    "vim", "icu", "imagemagick", "info-zip", "xnet", "naumen", "multics", "nokia", "sleepycat", "tcl", "python", "none", "noassertion"))
_SUFFIX, _VERSION = re.compile(r"(-only|-or-later|\+)$"), re.compile(r"-\d+(\.\d+)*$")
# The tag as whole words, like the automaton's, and what stands on its line before its expression
_TAG = re.compile(r"(?<![0-9a-z\x80-\xff])spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier(?![0-9a-z\x80-\xff])"
                  r"[^0-9a-z\x80-\xff(\n\r]*")
_LINE = re.compile(r"[^\n\r]*")
_TOKEN = re.compile(r"[()]|[0-9a-z][0-9a-z.+:-]*")
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def grade(label: str) -> float:
    """The grade of a label, else of its licence without ``-only``, ``-or-later`` or ``+``, else of its family without the version."""
    plain = _SUFFIX.sub("", label)
    return GRADES.get(label, GRADES.get(plain, GRADES.get(_VERSION.sub("", plain), UNKNOWN_GRADE)))


def is_id(token: str) -> bool:
    """Whether a word has the shape of a licence id: a known plain one, or letters with a digit or a hyphen."""
    return token in PLAIN_IDS or token in GRADES or token[:1].isalpha() and any(c == "-" or c.isdigit() for c in token)


def postfix(expression: str) -> list[str]:
    """Shunting-yard: the leading well-formed part of a lower-case expression, in postfix order.

    ``with`` binds before ``and``, ``and`` before ``or``. Reading stops where the text goes on with something else or with a
    word that is no licence id, so prose after the expression is not taken for it. An unfinished operator or bracket is left out.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        if operand_next and token == "(":
            stack.append(token)
        elif operand_next and token != ")" and token not in _BINDING and is_id(token.rstrip(".:-")):
            out.append(token.rstrip(".:-"))
            operand_next = False
        elif not operand_next and token in _BINDING:
            while stack and stack[-1] != "(" and _BINDING[stack[-1]] >= _BINDING[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        elif not operand_next and token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
    if operand_next:
        while stack and stack[-1] != "(" and not out:
            stack.pop()
        if stack and stack[-1] in _BINDING:
            stack.pop()
    return out + [t for t in reversed(stack) if t != "("]


def evaluate(expression: str) -> tuple[list[str], float | None]:
    """Labels of an expression and its grade: ``and`` takes the stricter side, ``or`` the freer, ``with`` the licence's."""
    values: list[tuple[list[str], float]] = []
    for token in postfix(expression):
        if token not in _BINDING:
            values.append(([token], grade(token)))
            continue
        if len(values) < 2:
            break
        (right, b), (left, a) = values.pop(), values.pop()
        if token == "with":
            values.append(([f"{left[-1]} with {right[0]}"] if len(left) == 1 else left, a))
        else:
            values.append((left + right, min(a, b) if token == "and" else max(a, b)))
    return values[-1] if values else ([], None)


def expressions(text: str) -> list[str]:
    """What follows each tag of a lower-case text, up to the end of the line or the next tag."""
    tags = list(_TAG.finditer(text))
    return [_LINE.match(text, tag.end(), end)[0]
            for tag, end in zip(tags, [*(t.start() for t in tags[1:]), len(text)], strict=True)]


def automaton() -> ahocorasick.Automaton:
    """Patterns are words between spaces; several meanings of one phrase share an entry."""
    found: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.setdefault(phrase, []).append((kind, label))
    out = ahocorasick.Automaton()
    for phrase, meanings in found.items():
        out.add_word(f" {phrase} ", (len(phrase) + 1, meanings))
    out.make_automaton()
    return out


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    words = b" ".join(raw.translate(_WORD_BYTES).split())
    if not words:
        return 0, 0, None, None, "", "", 0.0
    plain = f" {words.decode('latin-1')} "  # one character a byte: the patterns are ASCII
    base, labels, grades, starts, tagged = set(), set(), [], [], False
    for end, (back, meanings) in machine.iter(plain):
        for kind, label in meanings:
            if kind == "base":
                base.add(label)
                starts.append(end - back)
            if kind == "tag":
                tagged = True
            else:
                labels.add(label)
    grades = [grade(label) for label in labels]
    if tagged:
        for expression in expressions(raw.translate(_LOWER).decode("latin-1")):
            found, value = evaluate(expression)
            labels.update(found)
            grades += [value] if value is not None else []
    at = [plain.count(" ", 0, s) for s in (min(starts), max(starts))] if starts else [None, None]
    return (words.count(b" ") + 1, len(starts), at[0], at[1], ",".join(sorted(base)), ",".join(sorted(labels)),
            min(grades) if grades else 0.0)


_FOUND = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    machine = automaton()
    for frame in chunks(frames, 1000):
        out = pd.DataFrame([scan(t, machine) for t in frame["text"]], columns=_FOUND)
        for name in ("first_word", "last_word"):
            out[name] = out[name].astype("Int64")
        out["score"] = out["score"].astype(np.float64)
        yield pd.concat([frame[["doc_id", "no_id"]].reset_index(drop=True), out], axis=1)


def licenses(docs: DataFrame) -> DataFrame:
    """One row per document with the licences that its text names.

    ``n_base`` counts all places of base phrases, overlapping ones too; ``first_word`` and ``last_word`` are their
    smallest and largest start (null without any); ``labels`` are the base labels and those of further notices and of
    tagged expressions, read on the tag's own line as far as words have the shape of licence ids; ``score`` is the grade of all licences together (the strictest), 0 without any. A null or empty
    text has no words and empty labels. Rows that repeat are scanned like any other; further columns are ignored.
    """
    return with_own_id(with_plain_id(docs, "text").mapInPandas(
        _scan, "doc_id long, no_id boolean, n_words long, n_base long, first_word long, last_word long, base_labels string, "
               "labels string, score double"))
