"""Tree operators against brute force on random forests, chains and cycles."""

import random

import pytest
from helpers import record, records_frame, tree

from colloquy.operators import graph, project


def forests():
    rng = random.Random(7)
    out = []
    for size in (1, 2, 3, 5, 8, 13, 40, 40, 40):
        ids = [f"n{i:03}" for i in range(size)]
        parents = {n: (None if i == 0 or rng.random() < 0.1 else rng.choice(ids[:i])) for i, n in enumerate(ids)}
        times = {n: rng.choice([None, float(rng.randrange(20))]) for n in ids}
        out.append((parents, times, rng.choice(ids)))
    cyclic = {"a": "c", "b": "a", "c": "b", "d": "a", "e": "d"}
    out.append((cyclic, {}, "e"))
    out.append(({"a": "a", "b": None}, {}, "b"))
    chain = {f"x{i:04}": (f"x{i - 1:04}" if i else None) for i in range(700)}
    out.append((chain, {}, "x0699"))
    return out


@pytest.fixture(scope="module")
def linked(spark):
    cases = forests()
    records = [record(tree(parents, times), current, id=str(i)) for i, (parents, times, current) in enumerate(cases)]
    table = project.project_records(records_frame(spark, records)).cache()
    raw = {r.conversation_key: r for r in table.collect()}
    names = {(k, n.node_id): n.raw_id for k, r in raw.items() for n in r.nodes}
    order = {r.conversation_key: r.shard_ordinal for r in raw.values()}
    hashes = {(r.shard_ordinal, n.raw_id): n.node_id for r in raw.values() for n in r.nodes}
    return cases, table, graph.link_nodes(table), names, order, hashes


def walk(parents, start):
    seen, at = [], start
    while at is not None and at not in seen:
        seen.append(at)
        at = parents.get(at)
    return seen, at is not None


def below(parents, root):
    found, grown = {root}, True
    while grown:
        more = {n for n, p in parents.items() if p in found} - found
        found |= more
        grown = bool(more)
    return found


def test_active_path(linked):
    cases, _, links, names, order, _ = linked
    got = {}
    for r in links.where("position IS NOT NULL").collect():
        got.setdefault(order[r.conversation_key], {})[r.position] = names[(r.conversation_key, r.node_id)]
    for i, (parents, _, current) in enumerate(cases):
        path, cyclic = walk(parents, current)
        want = {} if cyclic else dict(enumerate(reversed(path)))
        assert got.get(i, {}) == want, i


def test_path_status(linked):
    cases, table, links, _, order, _ = linked
    got = {order[r.conversation_key]: r.status for r in graph.path_status(table, links).collect()}
    assert got == {i: "CYCLE" if walk(p, c)[1] else "OK" for i, (p, _, c) in enumerate(cases)}


def test_terminal_leaves(linked):
    cases, _, links, names, order, hashes = linked
    got = {
        (order[r.conversation_key], names[(r.conversation_key, r.node_id)]): r.terminal_leaf for r in links.collect()
    }
    for i, (parents, times, _) in enumerate(cases):
        inner = set(parents.values())
        for n in parents:
            leaves = [x for x in below(parents, n) if x not in inner]
            want = max(((times.get(x) or 0.0, hashes[(i, x)]) for x in leaves), default=(0, None))[1]
            assert got[(i, n)] == want, (i, n)


def test_all_paths(linked):
    cases, table, links, names, order, _ = linked
    got = {}
    for r in graph.all_paths(table, links).collect():
        key = (order[r.conversation_key], names[(r.conversation_key, r.leaf_node_id)])
        got.setdefault(key, {})[r.position] = names[(r.conversation_key, r.node_id)]
    want = {}
    for i, (parents, _, _) in enumerate(cases):
        for leaf in set(parents) - set(parents.values()):
            path, cyclic = walk(parents, leaf)
            if not cyclic:
                want[(i, leaf)] = dict(enumerate(reversed(path)))
    assert got == want


def test_branches(linked):
    cases, table, links, names, order, hashes = linked
    got = {}
    for r in graph.branch_lists(table, links).collect():
        got.setdefault((order[r.conversation_key], names[(r.conversation_key, r.parent_node_id)]), []).append(
            (r.branch_rank, r.leaf_node_id)
        )
    leaf_of = {(order[r.conversation_key], names[(r.conversation_key, r.node_id)]): r.terminal_leaf for r in links.collect()}
    want = {}
    for i, (parents, times, current) in enumerate(cases):
        path, cyclic = walk(parents, current)
        for at, n in [] if cyclic else list(enumerate(path)):
            kids = sorted((c for c, p in parents.items() if p == n), key=lambda c: (times.get(c) or 0.0, hashes[(i, c)]))
            rest = [(k + 1, leaf_of[(i, c)]) for k, c in enumerate(kids) if at == 0 or c != path[at - 1]]
            if rest:
                want[(i, n)] = rest
    assert {k: sorted(v) for k, v in got.items()} == want


def test_rounds_need_no_exchange(linked):
    _, table, _, _, _, _ = linked
    spark = table.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with graph.sql_conf(spark, **graph.CO_PARTITIONED):
            state = graph.checkpoint(graph._start(graph.checkpoint(graph.skeleton(table))))
            assert "Exchange" not in graph._double(state, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def sound_parents(parents):
    """Nodes that reach a root, with their parent if it is there."""
    out = {}
    for n in parents:
        path, endless = walk(parents, n)
        if not endless:
            out[n] = parents[n] if parents[n] in parents else None
    return out


def test_subtrees_are_intervals(linked):
    cases, table, links, names, order, hashes = linked
    rows = graph.tree_intervals(table, links)
    got = {(order[r.conversation_key], names[(r.conversation_key, r.node_id)]): r for r in rows.collect()}
    want = {(i, n) for i, (parents, _, _) in enumerate(cases) for n in sound_parents(parents)}
    assert set(got) == want
    for i, (parents, times, _) in enumerate(cases):
        sound = sound_parents(parents)
        place = {n: (times.get(n) or 0.0, hashes[(i, n)]) for n in sound}
        way = {n: [place[a] for a in reversed(walk(sound, n)[0])] for n in sound}
        assert sorted(sound, key=way.get) == sorted(sound, key=lambda n: got[(i, n)].pre)
        assert sorted(got[(i, n)].pre for n in sound) == list(range(len(sound)))
        for n in sound:
            mine = got[(i, n)]
            inside = {m for m in sound if mine.pre <= got[(i, m)].pre <= mine.last_pre}
            assert inside == below(sound, n) and mine.n_descendants == len(inside) - 1
    key_of = {i: k for k, i in order.items()}
    asked = table.sparkSession.createDataFrame(
        [(key_of[8], hashes[(8, n)]) for n in ("n000", "n005", "n039")] * 2, "conversation_key string, node_id string")
    parents = sound_parents(cases[8][0])
    found = {(names[(r.conversation_key, r.node_id)], names[(r.conversation_key, r.descendant_id)]) for r in graph.descendants(rows, asked).collect()}
    assert found == {(n, m) for n in ("n000", "n005", "n039") for m in below(parents, n) - {n}}
    up = sorted((names[(r.conversation_key, r.node_id)], r.position, names[(r.conversation_key, r.ancestor_id)]) for r in graph.ancestors(rows, asked).collect())
    assert up == sorted((n, k, m) for n in ("n000", "n005", "n039") for k, m in enumerate(reversed(walk(parents, n)[0])))


def test_list_ranking_needs_no_exchange(linked):
    _, table, links, _, _, _ = linked
    spark = table.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with graph.sql_conf(spark, **graph.CO_PARTITIONED):
            state = graph.checkpoint(graph._tour(table, links))
            assert "Exchange" not in graph._rank(state)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
