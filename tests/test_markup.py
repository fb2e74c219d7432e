"""Markup of documents in all its spellings."""

from __future__ import annotations

from pagelens.plans import registry
from pagelens.sources import markup


def test_capitals_attributes_and_other_tags(spark, tmp_path):
    texts = ["<DIV><P>one</P></DIV>", "<p class='x'>two</p>", "<section><h2>three</h2></section>", "see <br/>", "<p>four</p>", "3 < 4, <3 and </p> alone", "no markup", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()["dom_html_elements"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ord, r.tag, r.text) for r in rows) == [(0, 0, "div", None), (0, 1, "p", "one"), (1, 0, "p", "two"), (2, 0, "section", None), (2, 1, "h2", "three"), (3, 0, "br", None), (4, 0, "p", "four")]
    tags = registry.queries()["dom_html_tags"](spark, str(tmp_path)).collect()
    assert {r.tag: r.n for r in tags} == {"p": 3, "div": 1, "br": 1}


def test_unknown_sections_are_comments():
    assert [(r[3], r[9]) for r in markup.parse("<b>x <![foo bar]]> y</b><i>z</i>")] == [("b", "x y"), ("i", "z")]
