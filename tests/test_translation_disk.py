"""What a translation leaves in the shared folder: its outcomes only."""

from pathlib import Path

import pytest

from lexmill import queries
from lexmill.sources.scratch import _session_dir, materialize, passing


@pytest.mark.parametrize("name", ["translated_documents", "translated_running"])
def test_steps_go(spark, name):
    place = Path(_session_dir(spark).removeprefix("file:"))
    before = set(place.glob("*")) if place.exists() else set()
    done = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    left = {p.name.rsplit("-", 1)[0] for p in place.glob("translate-*") if p not in before and list(p.rglob("*.parquet"))}
    assert left <= {"translate-kept", "translate-memory", "translate-done"}
    assert done.count() > 100


def test_passing_keeps_what_it_is_told(spark):
    with passing() as keep:
        with passing() as inner:
            a = inner(materialize(spark.range(3), "passing-a"))
            b = materialize(spark.range(4), "passing-b")
        c = keep(materialize(a.unionByName(spark.range(1)), "passing-c"))
    assert c.count() == 4
    place = Path(_session_dir(spark).removeprefix("file:"))
    assert not [*place.glob("passing-a-*"), *place.glob("passing-b-*")] and b.schema
