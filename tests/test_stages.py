"""Matching is done once and written; what reads its findings several times doesn't match again."""

import time

import pytest

from lodewatch.functions.views import blank, quoted
from lodewatch.operators import ordering
from lodewatch.operators.remote_loads import facts
from lodewatch.plans import inventory, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [queries.seeded_summaries, queries.viewed_summaries])
def test_summaries_read_findings(spark, made):
    plan = made(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "regexp_replace" not in plan


def test_highlight_reads_summaries(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ordering, "staged", lambda df, name, own=ordering.staged: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), own(df, name))[1])
    inventory.o5_highlight(spark, DATA)
    assert len(seen) == 1 and "Aggregate" not in seen[0] and "Join" not in seen[0]


def test_repeated_code_is_one_file(spark):
    found = facts(spark.createDataFrame([("t", "a.js", "import('https://x.example/a.js')")] * 2, "target_id string, path string, content string"))
    assert found.filter("kind = 'load'").count() == 1


def test_texts_are_blanked_by_runs():
    text = "word and " * 2_000_000
    began = time.time()
    assert blank(text + "𝒳\n").endswith(" " * 11 + "\n") and quoted(f"'{text}'").startswith("'")
    assert time.time() - began < 4
