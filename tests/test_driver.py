"""What is joined over and over isn't broadcast: each broadcast goes through the driver."""

import pyarrow as pa
import pytest

from loomwright import graphs
from loomwright.operators import edits
from loomwright.plans import changeplan
from loomwright.shared import kept


@pytest.mark.parametrize("step", ["cycles", "order", "select"])
def test_no_broadcast(spark, monkeypatch, step):
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(graphs, "kept", noted)
    monkeypatch.setattr(changeplan, "kept", noted)
    ids = [f"x{i}" for i in range(12)]
    changes = spark.createDataFrame([(1, i, i, "ALTER", "TABLE", "p", "LOW", "SAFE_AUTOMATIC") for i in ids], "comparison_id int, id string, object_key string, kind string, object_type string, path string, risk string, automation string")
    edges = spark.createDataFrame([(1, a, b) for a, b in zip(ids, [*ids[1:6], "x0", *ids[7:], "gone"], strict=True)] + [(1, "x2", "x0"), (1, "x4", "x2")], "comparison_id int, id string, needs string")
    changes, edges = kept(changes, "changes"), kept(edges, "edges")
    if step == "cycles":
        out = changeplan.cycles_to_manual(changes, edges)
        assert {r.old_id for r in out.where("kind = 'MANUAL'").collect()} == set(ids[:6])
    elif step == "order":
        out = changeplan.order_changes(changes, changeplan.ordering_edges(edges))
        assert sorted(r.position for r in out.collect()) == list(range(1, 13))
    else:
        out = changeplan.select_changes(changes, edges, changes.select("comparison_id", "id"))
        assert {r.id for r in out.where("state = 'SELECTED'").collect()} == set(ids[:6])
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    # The starts of the ranges that number rows are one row a task.
    assert not [p for p in plans if "BroadcastHashJoin" in p.replace("BroadcastHashJoin [__part", "")]


def test_a_replay_s_queue_is_not_broadcast(spark, monkeypatch):
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(edits, "kept", noted)
    rows = kept(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "rows")
    told = kept(spark.createDataFrame([(1, 1, "UPDATE", ("1",), {"k": "3", "v": "c"}), (2, 2, "UPDATE", ("3",), {"v": None}), (3, 3, "DELETE", ("2",), None)], "edit_id long, edit_seq long, op string, key struct<k:string>, values map<string,string>"), "told")
    out, said = edits.replay(rows, told, ["k"])
    assert [tuple(r) for r in out.collect()] == [(3, None)] and {r.status for r in said.collect()} == {"APPLIED"}
    assert "BroadcastHashJoin" not in plans["replayed"] and "SortMergeJoin" in plans["replayed"]


def test_edits_of_a_slice():
    """Maps of a slice are read from their own places, and only those."""
    rows = [{"team": "t", "edit_id": i, "op": "UPDATE", "k": "a", "to": "b", "n_k": 1, "n_to": 0, "values": None if i % 3 == 0 else [(f"c{j}", str(i)) for j in range(i)]} for i in range(9)]
    kinds = {"team": pa.string(), "edit_id": pa.int64(), "op": pa.string(), "k": pa.string(), "to": pa.string(), "n_k": pa.int64(), "n_to": pa.int64(), "values": pa.map_(pa.string(), pa.string())}
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))
    for part in (batch, batch.slice(4, 3), batch.slice(9)):
        assert [(r[1], r[7]) for r in edits._columnwise(part)] == [(r["edit_id"], dict(r["values"] or [])) for r in part.to_pylist()]
