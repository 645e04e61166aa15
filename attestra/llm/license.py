"""License scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

All phrases go into one automaton that reads each text's word sequence once. Where the identifier tag occurs, the
expression that follows it is read from the raw line, parsed with the precedence WITH, AND, OR and evaluated: its
licences become labels, and it is permissive if a choice (OR) offers a permissive side or all parts (AND) are.

Scale: one pass in an Arrow stage, no shuffle, nothing broadcast; the automaton is built once a worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases of the contract.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notices by their public wording.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
PERMISSIVE = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0", "zlib", "0bsd", "cc-by-4.0")

#: Byte table: A-Z to a-z, all other ASCII but digits and letters to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_LINE = re.compile(r"spdx-license-identifier[\x00-\x20]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def evaluate(expression: str) -> tuple[frozenset[str], bool] | None:
    """Licences named and whether a permissive choice exists; None if it is no expression.

    The longest leading part that parses is taken, so prose after an expression does no harm. ``with`` stands between one
    licence and one exception, as the standard has it: anything else ends the expression before it. Time is linear in
    the tokens, whatever they are and however deep they nest.
    """
    tokens = [t.lower() for t in _TOKEN.findall(expression)]
    upto = depth = 0
    last = "("  # what came before: (, an operator, with, a licence (id), an exception, or )
    for i, t in enumerate(tokens):
        due = last in ("(", "operator")
        if t == "(" and due:
            depth, last = depth + 1, "("
        elif t == ")" and not due and last != "with" and depth:
            depth, last = depth - 1, ")"
        elif t == "with" and last == "id":
            last = "with"
        elif t in ("and", "or") and not due and last != "with":
            last = "operator"
        elif t not in _RANK and t not in "()" and (due or last == "with"):
            last = "id" if due else "exception"
        else:
            break
        if not depth and last in ("id", "exception", ")"):
            upto = i + 1
    if not upto:
        return None
    values: list[tuple[set[str], bool]] = []
    operators: list[str] = []

    def apply(op: str) -> None:
        right, left = values.pop(), values.pop()
        if op == "with":  # an exception only ever permits more
            values.append(({f"{next(iter(left[0]))}-with-{next(iter(right[0]))}"}, left[1]))
        else:
            small, large = sorted((left[0], right[0]), key=len)
            large.update(small)
            values.append((large, left[1] or right[1] if op == "or" else left[1] and right[1]))

    for t in tokens[:upto]:
        if t == "(":
            operators.append(t)
        elif t == ")":
            while operators[-1] != "(":
                apply(operators.pop())
            operators.pop()
        elif t in _RANK:
            while operators and operators[-1] != "(" and _RANK[operators[-1]] >= _RANK[t]:
                apply(operators.pop())
            operators.append(t)
        else:
            values.append(({t}, t in PERMISSIVE))
    while operators:
        apply(operators.pop())
    return frozenset(values[0][0]), values[0][1]


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: ""}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan_text(text: bytes, a: ahocorasick.Automaton) -> tuple:
    """n_words, places of base phrases as (word, phrase), notice phrases found, expressions as (text, result)."""
    found = text.translate(_WORDS).split()
    joined = f" {b' '.join(found).decode('utf-8', 'surrogateescape')} "
    places, notices, tagged = [], set(), False
    spaces = last = 0
    for end, phrase in a.iter(joined):
        if phrase in BASE:
            start = end - len(phrase) - 1
            spaces, last = (spaces + joined.count(" ", last, start), start) if start >= last else (joined.count(" ", 0, start), start)
            places.append((spaces, phrase))
        elif phrase == TAG:
            tagged = True
        else:
            notices.add(phrase)
    expressions = [(e, evaluate(e)) for e in _LINE.findall(text.decode("utf-8", "replace"))] if tagged else []
    return len(found), places, notices, expressions


_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_())]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = automaton()
    for batch in batches:
        rows = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            n, places, notices, expressions = scan_text(text or b"", a)
            base = {BASE[p] for _, p in places}
            read = [r for _, r in expressions if r]
            labels = base | {NOTICES[p] for p in notices} | {x for ids, _ in read for x in ids}
            doubt = 0.1 ** len(base) * 0.2 ** len(notices) * 0.01 ** len(read)
            at = [w for w, _ in places]
            permissive = any(ok for _, ok in read) or bool(base & {"mit", "apache-2"})
            rows.append((n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt if labels else 0.0, [e.strip() for e, _ in expressions], permissive if labels else None))
        columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_FIELDS)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *[name for name, _ in _FIELDS]])


def scan_licenses(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    expressions, permissive.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are their smallest and largest
    start (words from 0; null without any). Labels are distinct, sorted by code point and comma-joined. ``score`` is 0
    without labels, else one minus the product of each finding's doubt. ``permissive`` is null without labels. Null
    and empty texts have no words. Repeated rows give equal rows; other columns are ignored, whatever their names.
    """
    own = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    kind = own.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean"
    return own.mapInArrow(_scan, schema).withColumnRenamed("id", doc_id)
