"""Plans stay as small as they are: exchanges and leaf scans before adaptive execution, on the smallest tables."""

import re

import pytest
from pyspark.sql import functions as F

from quire import catalog
from quire.operators.tags import read_fragments
from quire.sources.lines import scan_lines

SF001 = "/root/testdata/sf0.001"
MOST = {"event_patterns": (4, 5), "event_sequences": (4, 5), "read_fragments": (15, 8), "html_marks": (0, 1), "symbols": (19, 9), "mention_rows": (10, 5),
        "references": (15, 6)}


@pytest.mark.parametrize("name", sorted(MOST))
def test_exchanges_and_scans(spark, name):
    catalog.load_all()
    plan = catalog.QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    count = lambda word: len(re.findall(rf"\b{word}\b", plan))
    assert (count("Exchange"), count("Scan")) <= MOST[name], plan
    assert count("Scan") <= MOST[name][1]


@pytest.mark.parametrize("name, steps", [("mention_rows", 1), ("mentions_in_symbols", 2)])
def test_the_running_sum_of_a_line_is_worked_out_once(spark, name, steps):
    catalog.load_all()
    plan = catalog.QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[starts", plan)) <= steps, plan


def test_fragments_read_back_as_often_as_asked(spark):
    lines = scan_lines(spark.createDataFrame([("a", "one\ntwo\nthree")], "path string, content string"))
    rows = [("a", 1, 5, 0, 2, "x"), ("a", 1, 5, 0, 2, "x"), ("a", 4, 3, 1, 1, None), ("gone", 0, 3, 0, 1, "own"), ("gone", 0, 3, 0, 1, None)]
    asked = spark.createDataFrame(rows, "path string, offset long, length long, line long, n_lines long, text string")
    got = [(r.path, r.offset, r.text, r.fragment_text) for r in read_fragments(asked, lines).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("a", 1, "x", "ne\ntw"), ("a", 1, "x", "ne\ntw"), ("a", 4, None, "two"), ("gone", 0, "own", "own"),
                                                     ("gone", 0, None, None)]))
    plain = read_fragments(asked.drop("text"), lines).where(F.col("path") == "gone").collect()
    assert [r.fragment_text for r in plain] == [None, None]
