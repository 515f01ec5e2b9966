"""Expensive parts of a row are worked out once, also after Spark has put projections and filters together."""

from __future__ import annotations

import pytest

from trailmark import catalog

DATA = "/root/testdata/sf0.001"


def optimized(spark, name):
    return catalog.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "part", "most"), [
    ("request_parts", "split(", 1),
    ("heuristic_rules", "from_json(StructField(type,StringType", 1),
    ("json_trace_counts", "$.argsValues[0]", 2),
])
def test_parts_are_worked_out_once(spark, name, part, most):
    assert 1 <= optimized(spark, name).count(part) <= most
