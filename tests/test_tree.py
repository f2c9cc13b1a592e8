"""Tree construction: cases for every insertion mode and algorithm, written as indented dumps."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from domframe import cases
from domframe.case_queries import TREES
from domframe.parser.builder import parse
from domframe.parser.dump import dump
from domframe.parser.flatten import rows

@pytest.mark.parametrize(("html", "want"), [case for rows in TREES.values() for case in rows])
def test_trees(html, want):
    assert dump(parse(html)) == want


@pytest.mark.parametrize(("html", "context", "want"), cases.FRAGMENTS)
def test_fragments(html, context, want):
    assert dump(parse(html, context)) == want


def test_quirks_decide_whether_a_table_ends_a_paragraph():
    assert [r[8] for r in rows(parse("<!DOCTYPE html><p><table>")) if r[6] == "element"][3:] == ["p", "table"]
    inside = rows(parse("<!DOCTYPE html PUBLIC 'x'><p><table>"))
    assert inside[-1][8] == "table" and inside[inside[-1][1]][8] == "p"


def test_flattened_intervals():
    r = rows(parse("<ul><li>a<li>b</ul><template><p>t</template><ul><li>a<li>b</ul>"))
    for me, parent, end, depth, *_ in r:
        assert end >= me
        if parent is not None:
            assert r[parent][0] < me <= end <= r[parent][2] and depth == r[parent][3] + 1
    lists = [x for x in r if x[8] == "ul"]
    assert lists[0][16] == lists[1][16]
    assert (lists[1][17], lists[1][18]) == (lists[0][1], lists[0][5])
    assert [x[12] for x in r if x[10] == "t"] == [True]


def test_deep_nesting_is_no_recursion():
    assert max(r[3] for r in rows(parse("<b>" * 3 + "<div>" * 3000))) > 3000


PARTS = st.lists(st.one_of(st.text(max_size=20), st.sampled_from([f"<{x}{t}>" for t in "div span p a b i em ul li table tr td th br hr select option svg math title script template form button h1".split() for x in ("", "/")]), st.sampled_from(["<!--", "-->", "<![CDATA[", "]]>", "&amp", "<a b='", "\n", " ", "\0"])), max_size=40)


@settings(max_examples=150, deadline=None)
@given(PARTS)
def test_any_text_parses_alike_and_to_well_formed_rows(parts):
    html = "".join(parts)
    first = rows(parse(html))
    assert first == rows(parse(html))
    assert [r[8] for r in first if r[6] == "element" and r[3] == 0] == ["html"]
    for r in first:
        assert r[6] in ("element", "text", "comment", "doctype", "content")
        assert (r[8] is not None) == (r[6] == "element")


@settings(max_examples=80, deadline=None)
@given(PARTS, st.sampled_from(["div", "tr", "select", "template", "svg path", "math mi", "textarea", "html"]))
def test_any_fragment_parses(parts, context):
    rows(parse("".join(parts), context))
