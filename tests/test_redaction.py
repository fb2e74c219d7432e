"""Redaction of whole pages: all lines and elements, by findings of both."""

from __future__ import annotations

import pytest

from pagelens.plans import registry

ELEMENT = "struct<target_id string, tag string, role string, type string, text string, name string, value string, placeholder string, aria_label string, bounds struct<x int, y int, width int, height int>>"


def element(target, kind=None, text=None, name=None, value=None, placeholder=None):
    return (target, "input", None, kind, text, name, value, placeholder, None, None)


@pytest.fixture
def folder(spark, tmp_path):
    pages = [
        (1, ([element("t", "tel", "663-555-6869", "t", None, "as 663-555-6869"), element("e", None, "mail", "ana@x.example", "ana@x.example"), element("p", "password", None, None, "hunter two"), element(None, None, None, None, "ana@x.example", None)], ["ring 663-555-6869 now", "mine is hunter two", None, "plain"])),
        (2, ([element("t", None, "Search")], ["nothing here"])),
        (3, (None, ["no elements: bob@y.example"])),
        (4, None),
    ]
    spark.createDataFrame(pages, f"obs_id long, observation struct<elements array<{ELEMENT}>, visibleText array<string>>").write.parquet(f"{tmp_path}/observations.parquet")
    spark.createDataFrame([(1, "to ana@x.example\nand ana@x.example, 663-555-6869"), (2, "nothing"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_all_lines_by_findings_of_elements_and_lines(spark, folder):
    out = {(r.kind, r.page, r.ord): r.text for r in registry.queries()["pii_redact_page_lines"](spark, folder).collect()}
    assert out == {
        ("o", 1, 0): "ring [REDACTED_PHONE] now", ("o", 1, 1): "mine is [REDACTED_ACCOUNT]", ("o", 1, 3): "plain", ("o", 2, 0): "nothing here", ("o", 3, 0): "no elements: [REDACTED_EMAIL]",
        ("d", 1, 0): "to [REDACTED_EMAIL]", ("d", 1, 1): "and [REDACTED_EMAIL], 663-555-6869", ("d", 2, 0): "nothing",
    }


def test_all_fields_of_elements(spark, folder):
    rows = registry.queries()["pii_redact_page_elements"](spark, folder).collect()
    hidden = "[REDACTED_SENSITIVE]"
    assert {(r.page, r.ord): (r.text, r.name, r.value, r.placeholder) for r in rows} == {
        (1, 0): ("[REDACTED_PHONE]", hidden, None, "as [REDACTED_PHONE]"),
        (1, 1): (hidden, "[REDACTED_EMAIL]", hidden, None),
        (1, 2): (hidden, hidden, hidden, None),
        (1, 3): ("", "", "[REDACTED_EMAIL]", None),
        (2, 0): ("Search", "", None, None),
    }
