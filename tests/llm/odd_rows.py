"""Rows that operators must survive, as fixtures to import (no conftest: other tests import the one above by name)."""

import pytest

#: Texts that operators must survive: null, empty, blanks, special strings, no blanks, repeated rows.
ODD = [
    None, "", " ", "\n\n", "a", "  two  blanks ", "▁ <s> </s> <|endoftext|>", "字😀​\x00é́", "x" * 6000, "the of and " * 400,
    "The same text of some words, twice in the table.", "The same text of some words, twice in the table.", "\x1c\x85  mixed\tblanks\r\n", "ab " * 9000,
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if i % 3 else None, "src" if i % 2 else None, 7, "clash", 1) for i, t in enumerate(ODD)] + [(None, "no id at all", "de", "src", 7, "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, id string, part int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("false")
