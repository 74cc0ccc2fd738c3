"""Record projection: one table of cases, projected once."""

import json

import pytest
from helpers import message, node, record, records_frame, tree
from pyspark.sql import functions as F

from colloquy.operators import graph, project

OPEN, CLOSE, SEP = "\ue200", "\ue201", "\ue202"
MIXED = {
    "root": node("root", None, ["a"]),
    "a": node("a", "root", ["b"], message(None, mid="ma")),
    "b": node("b", "a", ["c"], {"id": "mb", "content": {"parts": []}}),
    "c": node("c", "b", ["d"], message("  \n", mid="mc")),
    "d": node("d", "c", ["e"], message(f"{OPEN}cite{SEP}x{CLOSE}", mid="md")),
    "e": node("e", "d", ["f"], message("", mid="me", metadata={"attachments": [{"id": "file-1", "name": "n.png"}]})),
    "f": node("f", "e", [], message("shown", mid="mf", role="ASSISTANT")),
}
CASES = {
    "renderable": record(MIXED, "f"),
    "cycle": record(tree({"a": "b", "b": "a"}), "a"),
    "folded": record({"a": {"id": "a", "children": list(range(10_000))}}, "a"),
    "too_many_children": record({"a": {"id": "a", "children": ["x"] * 10_001}}, "a"),
    "types": json.dumps(
        {
            "id": 5, "conversation_id": "real", "title": 7, "create_time": "12", "update_time": 3, "archived": True,
            "is_archived": "yes", "starred": False, "current_node": 9,
            "mapping": {"k": {"id": 8, "parent": None, "message": {"author": {"role": 4}, "content": {"content": "c", "text": 1}}}},
        }
    ),
    "alias": record({"k1": node("n1", None, ["n2"], message("x")), "n2": node("n2", "k1", [], message("y"))}, "k1"),
    "parts": record(
        {"a": node("a", None, [], {"content": {"parts": ["", "x", "", {"text": "y"}, 5, {"text": 6, "content": "z"}, {"n": 1}]}})}, "a"
    ),
    "duplicate_ids": record({"k1": node("n"), "k2": node("n")}),
    "not_object": '"text"',
    "no_mapping": "{}",
    "array_mapping": '{"mapping": []}',
    "broken": '{"mapping": {',
    "trailing": '{"mapping": {}} x',
    "repeated_key": '{"mapping": {}, "title": "first", "title": "last"}',
    "long_text": record({"a": node("a", None, [], message("x" * (4 * 1024 * 1024 + 1)))}),
    "files": record(
        {
            "a": node("a", None, [], {
                "metadata": {"attachments": [
                    {"id": "file-1", "name": "a/b.png", "mime_type": "image/png; x"}, {"id": "file-1", "name": "a/b.png", "mime_type": "image/png; x"},
                    {"id": "only-id"}, {"title": "T", "id": 3}, "text", {"file_id": "f9"},
                ]},
                "content": {"parts": [{"asset_pointer": "p://file-2", "content_type": "image"}, {"name": "n"}, {"name": "n", "mime_type": "a/b"}]},
            })
        }
    ),
    "fallback": record(tree({"a": None, "b": "a", "c": "a"}, {"b": 5, "c": 4}), "gone"),
}


@pytest.fixture(scope="module")
def rows(spark):
    table = project.project_records(records_frame(spark, CASES.values())).cache()
    found = {r.shard_ordinal: r for r in table.collect()}
    return {name: found[i] for i, name in enumerate(CASES)}


def codes(row):
    return {d.code: d.occurrence_count for d in row.diagnostics}


def by_id(row):
    return {n.raw_id: n for n in row.nodes}


def test_rejections(rows):
    reasons = {name: row.reason for name, row in rows.items() if row.reason}
    assert reasons == {
        "not_object": "UNSUPPORTED_RECORD",
        "no_mapping": "UNSUPPORTED_RECORD", "array_mapping": "UNSUPPORTED_RECORD", "broken": "MALFORMED_RECORD",
        "trailing": "MALFORMED_RECORD",
    }


def test_nothing_is_refused_for_its_size(rows):
    assert len(rows["long_text"].nodes[0].message_text) == 4 * 1024 * 1024 + 1
    assert rows["too_many_children"].reason is None
    assert codes(rows["duplicate_ids"])["DUPLICATE_NODE_ID"] >= 1
    ids = [n.raw_id for n in rows["duplicate_ids"].nodes]
    assert len(ids) == len(set(ids)) >= 1


def test_long_conversation(spark):
    n = 3_000
    chain = {f"n{i}": node(f"n{i}", f"n{i - 1}" if i else None, [f"n{i + 1}"] if i + 1 < n else [], message("t", mid=f"m{i}")) for i in range(n)}
    row = project.project_records(records_frame(spark, [record(chain, f"n{n - 1}")])).select("reason", "n_nodes", "message_count").first()
    assert (row.reason, row.n_nodes, row.message_count) == (None, n, n)


def test_renderable_messages(rows):
    row = rows["renderable"]
    assert row.message_count == 2
    assert [n.raw_id for n in row.nodes if n.renderable] == ["e", "f"]
    assert by_id(row)["f"].role == "assistant" and by_id(row)["root"].role == "other"
    assert by_id(row)["d"].message_text == ""
    assert row.has_attachments


def test_typed_reads(rows):
    row = rows["types"]
    assert row.title == "Untitled conversation"
    assert (row.created_at, row.updated_at, row.archived, row.starred) == (None, 3.0, True, False)
    only = row.nodes[0]
    assert (only.raw_id, only.role, only.message_text) == ("k", "other", "c")
    assert codes(row) == {"FALLBACK_ACTIVE_LEAF": 1}


def test_text_parts(rows):
    assert rows["parts"].nodes[0].message_text == "x\n\ny\nz"


def test_alias_resolves_to_the_node(rows):
    row = rows["alias"]
    nodes = by_id(row)
    assert nodes["n2"].parent_node_id == nodes["n1"].node_id
    assert row.current_node == nodes["n1"].node_id
    assert codes(row) == {}


def test_folded_diagnostics(rows):
    assert codes(rows["folded"]) == {"INVALID_CHILD_REFERENCE": 10_000}


def test_fallback_leaf_is_the_latest(rows):
    row = rows["fallback"]
    assert row.current_node == by_id(row)["b"].node_id
    assert codes(row) == {"MISSING_CURRENT_NODE": 1, "FALLBACK_ACTIVE_LEAF": 1}


def test_repeated_key_takes_the_last(rows):
    assert rows["repeated_key"].title == "last"


def test_attachment_candidates(rows):
    found = [(a.reference, a.display_name, a.claimed_mime) for a in rows["files"].nodes[0].attachments]
    assert found == [
        ("file-1", "a_b.png", "image/pngx"), ("T", "T", None), ("f9", "Attachment", None),
        ("p://file-2", "Attachment", "image"), (None, "n", "a/b"),
    ]


def test_cycle_is_a_diagnostic(spark):
    table = project.project_records(records_frame(spark, [CASES["cycle"], CASES["fallback"]])).cache()
    links = graph.link_nodes(table)
    found = [(d.code, d.occurrence_count) for d in graph.cycle_diagnostics(table, links).collect()]
    assert found == [("ACTIVE_PATH_CYCLE", 1)]


def test_projection_moves_no_rows(spark):
    plan = project.project_records(records_frame(spark, ["{}"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_skeleton_scan_reads_no_text(spark, tmp_path):
    table = project.project_records(records_frame(spark, [CASES["renderable"]]))
    table.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = project.node_rows(stored, "node_id", "parent_node_id")._jdf.queryExecution().optimizedPlan()
    schema = plan.collectLeaves().head().output().mkString(" ")
    files = project.node_rows(stored, "node_id", "parent_node_id").select(F.count("*"))
    text = files._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "message_text" not in text, schema
