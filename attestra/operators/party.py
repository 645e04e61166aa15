"""Registered names and addresses, taken apart.

A line is cut at its commas, each token is described (is it a street, a ZIP code, a state, a corporate form?), and the
descriptions decide at which positions names end and the address stands. Names and address are then taken from there.
This runs row by row in one Arrow function.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.text import FORMS, RESPONSIBLE, STATES, py_fold, py_key

# Words that end a street.
STREET_WORDS = [
    "road", "rd", "street", "st", "avenue", "ave", "boulevard", "blvd", "drive", "dr", "lane", "ln", "way", "highway", "hwy", "route", "rte",
    "court", "ct", "place", "pl", "parkway", "pkwy", "circle", "cir", "trail", "trl", "terrace", "ter", "plaza", "square", "sq",
]
# How a street begins, the marker of a label's own name, ZIP codes, and what is trimmed from tokens.
STREET = re.compile(rf"^\s*(?:\d|p\.?\s*o\.?\s*box\b)|\b(?:{'|'.join(STREET_WORDS)})\.?\s*$", re.I)
OWN_NAME = re.compile(r"\(\s*used on label\s*\)", re.I)
ZIP = re.compile(r"\d{5}(?:-\d{4})?")
EDGE = " \t �"

_CODES = {name: code for code, name in STATES.items()}
_RESPONSIBLE = re.compile(RESPONSIBLE)
_PARTY = pa.struct([("names", pa.list_(pa.string())), ("city", pa.string()), ("state", pa.string()), ("zip_code", pa.string()), ("state_forms", pa.list_(pa.string()))])


class Token(NamedTuple):
    text: str
    own: bool  # marked as the label's own name
    zip: bool
    street: bool
    state: str | None  # its code
    form: bool  # a corporate form
    company: str  # what is left of a company's name when compared


def _token(part: str) -> Token:
    text = OWN_NAME.sub("", part).strip(EDGE)
    is_zip = ZIP.fullmatch(text) is not None
    code = text.upper() if len(text) == 2 and text.upper() in STATES else _CODES.get(py_fold(text))
    left = [w for w in py_key(_RESPONSIBLE.sub("", text)).split() if w not in FORMS and w != "the"]
    return Token(text, OWN_NAME.search(part) is not None, is_zip, not is_zip and STREET.search(text) is not None, code, py_key(text) in {*FORMS, "the"}, " ".join(left))


class Layout(NamedTuple):
    """Positions in a line's tokens: where names end, of city, state and ZIP, and from where on more names follow."""

    end: int
    city: int | None
    state: int | None
    zip: int | None
    more: int


def _layout(tokens: list[Token]) -> Layout:
    n, last = len(tokens), tokens[-1] if tokens else None
    for s, token in enumerate(tokens):
        if token.street:
            zip_there = s + 3 < n and tokens[s + 3].zip
            return Layout(s, s + 1, s + 2, s + 3 if zip_there else None, s + 3 + zip_there)
    closing = {  # how an address without a street ends, by how many tokens it takes up
        3: n > 3 and last.zip and tokens[-2].state,
        2: n > 2 and last.state,
        1: n == 2 and last.state and len(last.text) == 2,
    }
    size = next((k for k, fits in closing.items() if fits), 0)
    at = [None] * (3 - size) + list(range(n - size, n))
    city, state, zip_ = {3: at, 2: [*at[1:], None], 1: [None, at[2], None], 0: [None] * 3}[size]
    return Layout(n - size, city, state, zip_, n)


def _names(own: list[Token], others: list[Token]) -> list[str]:
    """Names to try: the label's own, then the others; a corporate form after a comma belongs to the name before it,
    and of names that are one company the first counts."""
    groups: list[list[Token]] = []
    for token in others:
        if token.form and groups:
            groups[-1].append(token)
        else:
            groups.append([token])
    first: dict[str, str] = {}
    for group in [*([t] for t in own[-1:]), *groups]:
        if group[0].company:
            first.setdefault(group[0].company, ", ".join(t.text for t in group))
    return list(first.values())


def party(line: str) -> dict:
    every = [_token(p) for p in (x.strip(EDGE) for x in line.split(",")) if p]
    tokens = [t for t in every if not t.own]
    of = _layout(tokens)
    city, state, zip_ = (tokens[k] if k is not None and k < len(tokens) else None for k in (of.city, of.state, of.zip))
    forms = [] if state is None else [state.state.lower(), STATES[state.state]] if state.state else [py_fold(state.text)]
    return {
        "names": _names([t for t in every if t.own], tokens[: of.end] + tokens[of.more :]), "city": city and city.text, "state": state and (state.state or state.text),
        "zip_code": zip_ and zip_.text, "state_forms": forms}


@F.arrow_udf(from_arrow_type(_PARTY))
def registered_party(lines: pa.Array) -> pa.Array:
    """Of a comma-separated registration line: names (the label's own first), city, state (its code where it is known),
    zip_code and state_forms (code and name of the state, folded). Null for null."""
    return pa.array([None if x is None else party(x) for x in lines.to_pylist()], _PARTY)
