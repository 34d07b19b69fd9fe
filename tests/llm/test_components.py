"""Components against a plain search, and what their steps leave in the shared folder and in the session."""

import os
import random

import pytest

pytest.importorskip("textloom.llm")

from textloom.llm.common import DELETE_EXCHANGES, Scratch  # noqa: E402
from textloom.llm.components import connected_components  # noqa: E402


def test_components_equal_a_plain_search_and_leave_one_table(spark):
    draw = random.Random(5)
    links = [(k, k + 1) for k in range(12)] + [(100, k) for k in range(101, 140)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(40)] + [(7, 7), (300, None)]
    least = {x: x for a, b in links if b is not None and a != b for x in (a, b)}
    for _ in least:
        for a, b in links:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    folder = spark.conf.get("spark.checkpoint.dir")
    before, setting = set(os.listdir(folder)), spark.conf.get(DELETE_EXCHANGES, None)
    found = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == least
    assert len(set(os.listdir(folder)) - before) == 1
    assert spark.conf.get(DELETE_EXCHANGES, None) == setting


def test_scope_gives_the_setting_back_after_a_failure(spark):
    before = spark.conf.get(DELETE_EXCHANGES, None)
    with pytest.raises(ValueError), Scratch(spark):
        assert spark.conf.get(DELETE_EXCHANGES) == "true"
        raise ValueError
    assert spark.conf.get(DELETE_EXCHANGES, None) == before
