"""Every query of the core over empty tables, and over tables with nulls in every column."""

from __future__ import annotations

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import pagelens
from pagelens.plans import registry


@pytest.fixture(scope="module")
def edges(data, tmp_path_factory):
    """Two folders: tables without rows, and with three rows of nulls and one real one."""
    at = tmp_path_factory.mktemp("edges")
    for kind in ("empty", "nulls"):
        os.makedirs(at / kind)
        for p in glob.glob(f"{data}/*.parquet"):
            one = pq.read_table(p).slice(0, 1)
            none = pa.table({f.name: pa.nulls(3, f.type) for f in one.schema}, schema=one.schema)
            pq.write_table(one.slice(0, 0) if kind == "empty" else pa.concat_tables([none, one]), at / kind / os.path.basename(p))
    return at


SLOW = ("hierarchy_split", "hierarchy_split_cycles")  # tested on fixtures of their own


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_queries_do_not_fail(spark, edges, kind):
    for name, query in registry.queries().items():
        if name not in SLOW:
            n = query(spark, str(edges / kind)).count()
            assert n >= 0, name


def test_the_interface_loads_by_name():
    assert pagelens.boxes.MOST_OVERLAP and "streams" in pagelens.__all__
    with pytest.raises(AttributeError):
        pagelens.nothing  # noqa: B018
