"""Small records and brute-force answers for the tests."""

import json


def message(text=None, role="user", mid="m", at=None, **extra):
    out = {"id": mid, "author": {"role": role}, "create_time": at}
    if text is not None:
        out["content"] = {"content_type": "text", "parts": [text]}
    out.update(extra)
    return out


def node(nid, parent=None, children=(), msg=None):
    return {"id": nid, "parent": parent, "children": list(children), "message": msg}


def record(mapping, current=None, **header):
    return json.dumps({"id": "r", "mapping": mapping, "current_node": current, **header}, ensure_ascii=False)


def tree(parents, times=None):
    """A record whose nodes have the given parents (``None`` for a root)."""
    kids = {}
    for n, p in parents.items():
        kids.setdefault(p, []).append(n)
    return {
        n: node(n, p, kids.get(n, []), message(f"text {n}", mid="m" + n, at=(times or {}).get(n)))
        for n, p in parents.items()
    }


def records_frame(spark, records):
    rows = [("conversations.json", i, r) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "shard_name string, shard_ordinal bigint, record string")
