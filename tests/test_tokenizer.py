"""Tokens: states, references and what the end of input does."""

import pytest

from domframe import cases
from domframe.functions.entities import lookup, numeric, unescape
from domframe.parser.tokenizer import tokenize


@pytest.mark.parametrize(("html", "want"), cases.TOKENS)
def test_tokens(html, want):
    assert tokenize(html) == want


@pytest.mark.parametrize(("state", "html", "want"), cases.STATES)
def test_initial_states(state, html, want):
    assert tokenize(html, state, "title") == want


def test_xml_violation_mode():
    assert tokenize("a\uffff\fb<!--x--y-->", xml_violation_mode=True) == [("chars", "a\ufffd b"), ("comment", "x- -y")]


@pytest.mark.parametrize(("text", "want"), cases.REFERENCES)
def test_references_in_text(text, want):
    assert unescape(text) == want


@pytest.mark.parametrize(("text", "want"), cases.ATTRIBUTE_REFERENCES)
def test_references_in_attributes(text, want):
    assert unescape(text, True) == want


def test_lookup_gives_the_rest():
    assert lookup("notit;") == ("¬", "it;")
    assert lookup("zz") is None
    assert numeric(0x9F) == "Ÿ"
