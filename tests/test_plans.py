"""Plan shape guards: pruned scans, broadcast dimensions, no cross joins or row UDFs."""

import contextlib
import io

import pytest

from pitwall.plans import catalog

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["leaderboard_latest", "anomaly_gaussian", "commentary_generate",
                                  "vector_topk", "position_changes", "race_history"])
def test_plan_shape(spark, name):
    text = _plan(catalog.QUERIES[name](spark, SF))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython"):
        assert bad not in text
    scans = [ln for ln in text.splitlines() if ln.startswith("ReadSchema:")]
    assert scans and all("props" not in ln for ln in scans)       # unused columns are not read
    if name != "vector_topk":
        assert "BroadcastHashJoin" in text                          # roster joined without a shuffle


def test_topk_uses_group_limit(spark):
    text = _plan(catalog.QUERIES["vector_topk"](spark, SF))
    assert "WindowGroupLimit" in text
