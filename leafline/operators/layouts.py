"""Layout answers of a model: arrays of cells that may be broken JSON, mended by few sure edits.

Where the parser stops says what is wrong.  A string that a stray quote mark closed early
gets that mark escaped, a backslash that escapes nothing gets the quote mark it stood
for, text after the first whole value goes, and control characters inside strings are let
through.  Other faults are left alone: an answer that is not understood is reported
and not guessed.  What parses must be cells, each with a box of an area and a category.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

#: Edits after which an answer is given up.
MOST_EDITS = 3
# What the parser says, and the edit that it calls for.
EARLY_CLOSE = ("Expecting ',' delimiter", "Expecting ':' delimiter", "Expecting property name enclosed in double quotes")
AFTER_COMMA, LOOSE_BACKSLASH, TRAILING, CONTROL = EARLY_CLOSE[2], "Invalid \\escape", "Extra data", "Invalid control character at"


def _early_mark(text: str, at: int, message: str) -> str | None:
    """The quote mark before ``at`` escaped; the parser may have taken one comma after it."""
    head = text[:at].rstrip()
    if message == AFTER_COMMA and head.endswith(","):
        head = head[:-1].rstrip()
    body = head.removesuffix('"')
    slashes = len(body) - len(body.rstrip("\\"))
    return None if body == head or slashes % 2 else f'{body}\\"{text[len(head):]}'


def _marked(text: str, at: int, message: str) -> str | None:
    return f'{text[: at + 1]}"{text[at + 1 :]}' if text[at : at + 1] == "\\" else None


def _first_value(strict: bool) -> Callable[[str, int, str], str | None]:
    def cut(text: str, at: int, message: str) -> str | None:
        return text[: json.JSONDecoder(strict=strict).raw_decode(text)[1]]

    return cut


def fault_of(value: object) -> str | None:
    """Why a value is no array of cells; null if it is one."""
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    if not isinstance(value, list) or not value:
        return "no array" if not isinstance(value, list) else "no cell"
    for k, cell in enumerate(value):
        box = cell.get("bbox") if isinstance(cell, dict) else None
        if not isinstance(box, list) or len(box) != 4 or not all(map(number, box)):
            return f"cell {k}: no box of four numbers"
        if box[0] >= box[2] or box[1] >= box[3]:
            return f"cell {k}: a box without an area"
        if not isinstance(cell.get("category"), str):
            return f"cell {k}: no category"
    return None


def mended(text: str | None, most: int = MOST_EDITS) -> tuple[list | None, list[str], str | None]:
    """The cells of an answer, the edits made in order, and, without cells, what is wrong."""
    text, edits, strict = text or "", [], True
    while True:
        try:
            value = json.loads(text, strict=strict)
        except json.JSONDecodeError as error:
            arms: dict[str, tuple[str, Callable]] = dict.fromkeys(EARLY_CLOSE, ("escaped", _early_mark)) | {LOOSE_BACKSLASH: ("marked", _marked), TRAILING: ("cut", _first_value(strict))}
            if len(edits) == most:
                return None, edits, f"{error.msg} after {most} edits"
            if error.msg == CONTROL and strict:
                strict = False
                edits.append("controls")
                continue
            name, arm = arms.get(error.msg, ("", lambda *_: None))
            changed = arm(text, error.pos, error.msg)
            if changed is None:
                return None, edits, error.msg
            text = changed
            edits.append(name)
        else:
            fault = fault_of(value)
            return (value if fault is None else None), edits, fault


CELLS = StructType().add("cells", ArrayType(StructType().add("bbox", ArrayType(DoubleType())).add("category", StringType()).add("text", StringType()))).add("edits", ArrayType(StringType())).add("fault", StringType())
_CELLS = pa.struct([("cells", pa.list_(pa.struct([("bbox", pa.list_(pa.float64())), ("category", pa.string()), ("text", pa.string())]))), ("edits", pa.list_(pa.string())), ("fault", pa.string())])


@F.arrow_udf(CELLS)
def cells(answers: pa.Array) -> pa.Array:
    """``mended`` of each answer: its ``cells``, the ``edits`` and the ``fault``; other members of a cell are not kept."""
    rows = []
    for answer in answers.to_pylist():
        found, edits, fault = mended(answer)
        shown = None if found is None else [{"bbox": [float(v) for v in c["bbox"]], "category": c["category"], "text": None if c.get("text") is None else str(c["text"])} for c in found]
        rows.append({"cells": shown, "edits": edits, "fault": fault})
    return pa.array(rows, _CELLS)
