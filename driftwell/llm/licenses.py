"""Licence scans: notice phrases and identifier tags by one Aho-Corasick pass, expressions by a shunting-yard parser.

Words are runs of ASCII letters and digits and of any other character beyond ASCII, A-Z in lower case. The automaton
reads the words of a text joined by single spaces, so a phrase matches where its words stand consecutively. Where it
meets an identifier tag, the rest of that line is parsed as a licence expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftwell.llm.base import byte_rows, table

#: Phrases every scan knows, with their labels. Fixed values.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases, with labels.
NOTICES = {
    "apache license version 2 0": "apache-2.0", "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0", "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "isc license": "isc",
    "creative commons attribution": "cc-by", "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd", "released into the public domain": "public-domain",
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
#: What a licence asks of those who pass the work on: 0 little, 1 its own files' source, 2 the whole work's source.
DUTIES = {"gpl": 2, "agpl": 2, "lgpl": 1, "mpl": 1, "epl": 1, "cddl": 1}
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.:+-]+|\S")
IDENTIFIER = re.compile(r"[a-z0-9][a-z0-9.:-]*\+?")
BINDING = {"or": 1, "and": 2, "with": 3}
#: Bytes that do not part words stay, A-Z become lower case, all others become spaces.
WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


class BadExpression(ValueError):
    """A licence expression that does not parse."""


def postfix(expression: str) -> list[str]:
    """The expression in postfix order: with binds before and, and before or."""
    out, held, operand = [], [], False
    for token in TOKEN.findall(expression):
        low = token.lower()
        if low in BINDING:
            if not operand:
                raise BadExpression(f"{token} without an operand")
            while held and held[-1] != "(" and BINDING[held[-1]] >= BINDING[low]:
                out.append(held.pop())
            held.append(low)
            operand = False
        elif token == "(":
            if operand:
                raise BadExpression("two operands")
            held.append(token)
        elif token == ")":
            if not operand:
                raise BadExpression("empty brackets")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise BadExpression("closing bracket")
            held.pop()
        else:
            if operand or not IDENTIFIER.fullmatch(low):
                raise BadExpression(token)
            out.append(low)
            operand = True
    if not operand or "(" in held:
        raise BadExpression("it ends early")
    return out + held[::-1]


def evaluate(expression: str) -> tuple[set[str], int]:
    """The licences of an expression and its duty: the least of alternatives, the greatest of what holds together.

    An exception lowers the duty of its licence by one and is no licence itself.
    """
    stack: list[tuple[set[str], int]] = []
    for token in postfix(expression):
        if token not in BINDING:
            stack.append(({token.rstrip("+")}, DUTIES.get(token.split("-")[0], 0)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        stack.append((left, max(a - 1, 0)) if token == "with" else (left | right, min(a, b) if token == "or" else max(a, b)))
    return stack[0]


def automaton(phrases: dict[str, tuple]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        out.add_word(f" {phrase} ".encode().decode("latin-1"), (len(phrase.encode()) + 1, *value))
    out.make_automaton()
    return out


def scanner(base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES):  # noqa: ANN201
    """A function of a text's bytes: (n_words, n_base, first, last, base labels, labels, score, duty, expressions)."""
    own = {p: ("notice", x) for p, x in notices.items()} | {TAG: ("tag", "")}
    find = automaton(own | {p: ("base", x) for p, x in base.items()}).iter

    def scan(raw: bytes) -> tuple:
        words = raw.translate(WORDS).split(b" ")
        words = [w for w in words if w] if b"" in words else words
        joined = f" {b' '.join(words).decode('latin-1')} "
        n_base, first, last, tagged = 0, None, None, False
        base_labels, labels, duty, score = set(), set(), 0, 0.0
        at = seen = 0
        for end, (size, kind, label) in find(joined):
            if kind == "base":
                start = end - size
                # words before it: matches come by their ends, so a start may lie a little before the last one counted
                seen, at = (seen + joined.count(" ", at, start), start) if start >= at else (seen - joined.count(" ", start, at), start)
                n_base += 1
                first = seen if first is None else min(first, seen)
                last = seen if last is None else max(last, seen)
                base_labels.add(label)
                score = max(score, 0.6)
            elif kind == "notice":
                score = max(score, 0.9)
            else:
                tagged = True
            if label:
                labels.add(label)
                duty = max(duty, DUTIES.get(label.split("-")[0], 0))
        expressions = []
        if tagged:
            for m in TAG_LINE.finditer(raw.decode("utf-8", "replace")):
                try:
                    found, asks = evaluate(m[1].strip().rstrip("*/ -").strip())
                except BadExpression:
                    continue
                expressions.append(m[1].strip())
                labels |= found
                duty, score = max(duty, asks), 1.0
        return len(words), n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, duty, expressions

    return scan


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """What each whole text says of licences: the columns of ``scanner`` by doc_id.

    ``score`` is 1 for a well-formed identifier tag, 0.9 for a notice, 0.6 for a base phrase alone, else 0. Null and empty
    texts have no word, no place and no label; malformed expressions are left out; repeated rows are scanned alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(base, notices)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int32(), pa.list_(pa.string())]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "duty", "expressions"]
        for batch in batches:
            cols = zip(*map(scan, byte_rows(batch.column(1))), strict=True) if batch.num_rows else [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, duty int, expressions array<string>")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("duty", "expressions")
