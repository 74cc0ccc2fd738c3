"""Structure report: exact counters and no values."""

import json

from helpers import records_frame

from colloquy.operators import profile

CANARY = {
    "id": "CANARY", "conversation_id": "x", "title": "CANARY", "create_time": 1, "update_time": 2, "current_node": "a",
    "is_archived": True, "archived": False, "is_starred": None, "starred": 1, "odd": "CANARY",
    "mapping": {
        "a": {"id": "a", "parent": "b", "children": ["b"], "x": 1, "message": {"y": 1, "author": {"z": 1}, "content": {"w": "CANARY"}}},
        "b": {"id": "b", "parent": "a", "children": ["gone", 5]},
    },
}


def test_counters(spark):
    records = [json.dumps(CANARY), '"text"', "7", "null"]
    report = profile.completion(profile.structure_report(records_frame(spark, records)))
    row = report.first().asDict(recursive=True)
    present = row.pop("knownFieldPresence")
    assert set(present.values()) == {1} and len(present) == 11
    assert row == {
        "shardCount": 1, "parsedShardCount": 1, "malformedShardCount": 0, "conversationRecordCount": 4, "objectRecordCount": 1,
        "nonObjectRecordCount": 3, "mappingNodeCount": 2, "missingReferenceCount": 1, "cycleCount": 1, "oversizedRecordCount": 0,
        "unknownKeyCount": 5, "sourceUnchanged": True, "completion": "complete",
    }
    text = profile.report_json(report).first().report
    assert list(json.loads(text)) == list(profile.REPORT_FIELDS) and "CANARY" not in text


def test_malformed_record_ends_its_shard(spark):
    rows = records_frame(spark, ["{}", "{", "{}"])
    bad = spark.createDataFrame([("conversations-9.json",)], "shard_name string")
    row = profile.completion(profile.structure_report(rows, bad, source_unchanged=False)).first()
    assert (row.shardCount, row.malformedShardCount, row.conversationRecordCount, row.objectRecordCount) == (2, 2, 2, 1)
    assert row.completion == "partial"


def test_other_shapes_give_the_empty_report(spark):
    text = profile.report_json(spark.range(1)).first().report
    assert json.loads(text)["shardCount"] == 0 and list(json.loads(text)) == list(profile.REPORT_FIELDS)


def test_back_edges():
    assert profile.back_edges([(0, 1), (1, 2)], 3) == 0
    assert profile.back_edges([(1, 0), (0, 1), (0, 1)], 2) == 1
    assert profile.back_edges([(0, 0)], 1) == 1
    assert profile.back_edges([(0, 1), (0, 2), (1, 3), (2, 3), (3, 0)], 4) == 1
    assert profile.back_edges([(i + 1, i) for i in range(5000)] + [(0, 5000)], 5001) == 1


def test_names_and_references(spark):
    """Keys and ids both name a node, the first of a name stands, and every lost reference counts.

    Nodes go by their keys, so ``a`` is the node of key ``c``.
    """
    mapping = {
        "k0": {"id": "a", "children": ["b", "b", "lost", None]}, "b": {"parent": "a", "children": ["c"]},
        "c": {"id": "a", "parent": "lost", "children": ["k0"]}, "d": {"parent": "k0"},
    }
    records = [json.dumps({"mapping": mapping, "current_node": "nowhere"}), json.dumps({"mapping": {}, "current_node": "x"}), "{}"]
    rows = {r.shard_ordinal: r for r in profile.record_counters(records_frame(spark, records)).collect()}
    assert (rows[0].missing, rows[0].cycles) == (3, 2)
    assert (rows[1].missing, rows[1].cycles, rows[2].missing, rows[2].cycles) == (1, 0, 0, 0)
