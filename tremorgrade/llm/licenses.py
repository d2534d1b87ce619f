"""License scans: phrases and identifier tags by Aho-Corasick, expressions by shunting-yard.

A text's words (a run of digits, letters a-z or anything beyond ASCII) are joined by
single blanks, so one automaton over the joined words finds every place of every
phrase in one pass. A place of the tag words opens a search of the raw line behind
it for a licence expression, which is parsed by precedence (WITH over AND over OR)
and judged. Null texts are empty; empty texts have no words, no places, no labels
and score 0. The operator works row by row: nothing is shuffled or joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tremorgrade.llm.batches import as_bytes, pieces

#: The base phrases and the labels they give.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Further notice phrases.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "all-rights-reserved",
}

#: Words that open an identifier tag.
TAG_PHRASE = "spdx license identifier"

#: Families that licence identifiers start with.
FAMILIES = {
    "apache": "apache", "agpl": "agpl", "bsd": "bsd", "cc-by": "cc-by", "cc0": "cc0", "epl": "epl",
    "gpl": "gpl", "isc": "isc", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl", "unlicense": "unlicense",
}
PERMISSIVE = frozenset({"apache", "bsd", "cc-by", "cc0", "isc", "mit", "unlicense"})

_SEPARATORS = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TO_BLANK = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_TAG = re.compile(rb"spdx-license-identifier\s*:((?:(?!spdx-license-identifier)[^\r\n])*)", re.IGNORECASE)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+:-]+)")
_PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}
_LOWER = {"or", "and", "with"}

_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, expressions array<string>"
)


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard; reading stops at the first character or token that can't belong to an
    expression. Prose may follow one, so a lower-case operator counts only before a known
    identifier or a bracket."""
    output: list[str] = []
    stack: list[str] = []
    operand_next = True
    read = list(_tokens(expression))
    for token, following in zip(read, [*read[1:], ""], strict=False):
        word = token
        if token in _LOWER and (following == "(" or family(following)):
            word = token.upper()
        if token == "(" and operand_next:
            stack.append(token)
        elif token == ")" and not operand_next and "(" in stack:
            while stack[-1] != "(":
                output.append(stack.pop())
            stack.pop()
        elif word in _PRECEDENCE and not operand_next:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[word]:
                output.append(stack.pop())
            stack.append(word)
            operand_next = True
        elif operand_next and token not in "()" and word not in _PRECEDENCE:
            output.append(token)
            operand_next = False
        else:
            break
    if operand_next and stack and stack[-1] in _PRECEDENCE:
        stack.pop()
    return output + [token for token in reversed(stack) if token != "("]


def _tokens(expression: str) -> Iterator[str]:
    at = 0
    while found := _TOKEN.match(expression, at):
        yield found[1]
        at = found.end()


def judge(postfix: list[str]) -> tuple[set[str], float]:
    """Labels in an expression, and how freely it lets one use the text (0 to 1).

    OR leaves the choice (the better side counts), AND binds to both (the worse
    side), WITH adds an exception to its left side and names no licence. An identifier
    of no known family has no label and counts as not free.
    """
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in _PRECEDENCE and len(stack) >= 2:
            (right, b), (left, a) = stack.pop(), stack.pop()
            if token == "WITH":
                stack.append((left, min(1.0, a + 0.1)))
            else:
                stack.append((left | right, max(a, b) if token == "OR" else min(a, b)))
        else:
            label = family(token)
            stack.append(({label} if label else set(), 1.0 if label in PERMISSIVE else 0.5))
    return stack[-1] if stack else (set(), 0.0)


def family(identifier: str) -> str | None:
    lower = identifier.lower()
    return next((FAMILIES[f] for f in FAMILIES if lower.startswith(f)), None)


class Scanner:
    """One automaton over base phrases, notices and the tag words."""

    def __init__(self, base: dict[str, str], notices: dict[str, str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for phrase in [*base, *notices, TAG_PHRASE]:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()
        self.base, self.notices = base, notices

    def scan(self, doc_id: int | None, text: bytes) -> dict:
        words = text.lower().translate(_TO_BLANK).split()
        joined = b" ".join([b"", *words, b""]).decode("latin-1")
        places: list[int] = []
        base_labels: set[str] = set()
        labels: set[str] = set()
        tagged = False
        known, seen = 0, 0
        for end, phrase in self.automaton.iter(joined):
            if phrase in self.base:
                start = end - len(phrase) - 1
                seen += joined.count(" ", known, start) if start >= known else -joined.count(" ", start, known)
                known = start
                places.append(seen)
                base_labels.add(self.base[phrase])
            elif phrase in self.notices:
                labels.add(self.notices[phrase])
            else:
                tagged = True
        expressions, freedom = [], []
        for found in _TAG.finditer(text) if tagged else ():
            postfix = to_postfix(found[1].decode("utf-8", "replace"))
            named, free = judge(postfix)
            if postfix:
                labels |= named
                freedom.append(free)
                expressions.append(" ".join(postfix))
        labels |= base_labels
        if not freedom:
            freedom = [1.0 if label in PERMISSIVE else 0.5 for label in labels]
        return {
            "doc_id": doc_id,
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(labels)),
            "score": min(freedom, default=0.0),
            "expressions": expressions,
        }


def scan_licenses(
    documents: DataFrame,
    base: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
) -> DataFrame:
    """Licence findings of every (doc_id, text); ``score`` is how freely the text may be
    used by its strictest expression or notice, 0 where nothing is found."""
    phrases = (base or BASE_PHRASES, notices or NOTICE_PHRASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*phrases)
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("n_words", pa.int64()),
                ("n_base", pa.int64()),
                ("first_word", pa.int64()),
                ("last_word", pa.int64()),
                ("base_labels", pa.string()),
                ("labels", pa.string()),
                ("score", pa.float64()),
                ("expressions", pa.list_(pa.string())),
            ]
        )
        for batch in pieces(batches, "text"):
            ids = batch["doc_id"].to_pylist()
            found = [scanner.scan(i, t) for i, t in zip(ids, as_bytes(batch["text"]), strict=True)]
            yield pa.RecordBatch.from_pylist(found, schema)

    return documents.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
