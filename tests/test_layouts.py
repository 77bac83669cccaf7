"""Broken layout answers: which are mended, how, and which are left alone."""

import pytest

from leafline.operators import layouts

CELL = '{"bbox": [0, 0, 2, 1], "category": "Text", "text": "%s"}'


@pytest.mark.parametrize(
    ("answer", "edits", "text"),
    [
        (f"[{CELL % 'a'}]", [], "a"), (f"[{CELL % 'out.\" and she'}]", ["escaped"], 'out." and she'), (f"[{CELL % 'out.\", and she'}]", ["escaped"], 'out.", and she'), (f"[{CELL % r'see \) x'}]", ["marked"], 'see ") x'),
        (f"[{CELL % 'a'}]]", ["cut"], "a"), (f"[{CELL % 'a'}", None, "Expecting ',' delimiter"), (f"[{CELL % ('a' + chr(10) + 'b' + chr(9))}]", ["controls"], "a\nb\t"), (f"[{CELL % ('a' + chr(10) + 'b')}]]", ["controls", "cut"], "a\nb"),
        (f"[{CELL % 'a'} {CELL % 'b'}]", None, "Expecting ',' delimiter"), ("", None, "Expecting value"), (None, None, "Expecting value"), ("[]", None, "no cell"), ('{"a": 1}', None, "no array"), ("[1]", None, "cell 0: no box of four numbers"),
        ('[{"bbox": [0, 0, true, 1], "category": "x"}]', None, "cell 0: no box of four numbers"), ('[{"bbox": [2, 0, 2, 1], "category": "x"}]', None, "cell 0: a box without an area"), ('[{"bbox": [0, 0, 2, 1]}]', None, "cell 0: no category"),
        (f"[{CELL % r'a \\" b'}]", ["escaped"], 'a \\" b'),
    ],
)
def test_answers(answer, edits, text):
    cells, made, fault = layouts.mended(answer)
    if edits is None:
        assert cells is None and fault == text
    else:
        assert (made, cells[0]["text"], fault) == (edits, text, None)


def test_few_edits_are_made():
    two = 'a" b" c'
    assert layouts.mended(f"[{CELL % two}]")[1] == ["escaped", "escaped"]
    assert layouts.mended(f"[{CELL % (two * 3)}]")[0] is None and len(layouts.mended(f"[{CELL % (two * 3)}]")[1]) == 3
