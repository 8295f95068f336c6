"""Pages with unclosed heads and unseen elements, and with attributes named y."""
import pytest

from maskfold.llm.html_content import Page, train
from maskfold.llm.labelled_pages import PAGES

BODY = "<article><h1>T</h1><p>Body text</p></article>"
CASES = [
    (f"<html><head><title>x</title><meta charset=utf-8><link rel=a href=b>{BODY}</html>", "T\nBody text"),
    (f"<head><style>p{{}}</style><script>var x='<p>no</p>';</script></head><body>{BODY}</body>", "T\nBody text"),
    (f"<head><title>x</title><body>{BODY}", "T\nBody text"),
    (f"<head><title>x<body>{BODY}</body>", "T\nBody text"),
    *((f"<article><div><{tag}>x</div><h1>T</h1><p>Body text</p></article>", "T\nBody text")
      for tag in "noscript template svg math canvas datalist".split()),
    *((f"<body><{tag}>{BODY}</body>", "T\nBody text") for tag in "noscript template svg math canvas datalist".split()),
    ("<article><svg><svg/><text>no</text></svg><p>Body text</p></article>", "Body text"),
    ("<article><svg a='>'><g><path d=x /><text>no</text></g></svg><p>Body text</p></article>", "Body text"),
    ("<article><script>var s = \"<script\";</script><p>Body text</p><p>He said \"so\"</p></article>", 'Body text\nHe said "so"'),
    ("<article><noscript><p>no</p></noscript><p>Body text</p></article>", "Body text"),
    *((f"<article><p y={y}>Body text</p></article>", "Body text") for y in ('"10.5"', '""', '"auto"', '"0"', "7")),
]


@pytest.fixture(scope="module")
def model():
    return train(PAGES)


@pytest.mark.parametrize("source,want", CASES)
def test_unclosed(model, source, want):
    assert model.text(source) == want


def test_many_unclosed_elements_are_read_in_time(model):
    assert model.text("<article>" + "<div><svg></div>" * 20000 + "<p>Body text</p></article>") == "Body text"
    assert len(Page("<svg>" * 100000 + "<title>" * 1000).nodes) == 1


def test_labels_only_where_asked():
    assert [n.label for n in Page('<p y="0">x</p>').nodes] == [1, 0, 0]
    assert [n.label for n in Page('<p y="0">x</p>', labelled=False).nodes] == [1, 1, 1]
