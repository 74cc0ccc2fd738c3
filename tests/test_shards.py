"""Array scan over split files, and what is refused."""

import json
import random

import numpy as np
import pytest

from colloquy.plans import ingest
from colloquy.session import fixed_splits
from colloquy.sources import listing, shards

GOOD = {
    "conversations.json": '[{"a":"x,]}"},{"b":[{"c":1},{"d":"}{"}]}, 5 , "s}", {"e":"q\\"}"},[1,{"z":2}], null]',
    "conversations-001.json": " [ ] ",
    "conversations-002.json": '[{"a":1},{"b":tru},{"c":2}]',
    "conversations-11.json": '[{"a":[[],{"b":[1,[2]]},[{}]]}, [[{"c":[]}]], {"d":{"e":[]}}]',
    "conversations-12.json": "[1,[2,[]],3]",
    "conversations-10.json": json.dumps([{"i": i, "t": 'é}"{[,\\' * (i % 7)} for i in range(60)], ensure_ascii=False),
}
BAD = {
    "conversations-003.json": '[{"a":1},{"b":2}] x', "conversations-004.json": '{"a":1}',
    "conversations-005.json": '[{"a":1},{"b":2}', "conversations-007.json": '[{"a":1}, {"b": ] }, {"c":1}]',
    "conversations-008.json": '["unterminated]', "conversations-009.json": '[{"a":1}]]',
    "conversations-013.json": "[1]][", "conversations-014.json": '[{"a":1}],[{"b":2}]', "conversations-015.json": "[1],[2]",
}


@pytest.fixture(scope="module")
def export(tmp_path_factory):
    root = tmp_path_factory.mktemp("export")
    for name, text in {**GOOD, **BAD, "conversations-x.json": "[1]", "file-1.dat": "x", "File_2.DAT": "yy"}.items():
        (root / name).write_text(text, encoding="utf8")
    return str(root)


def elements(rows):
    return {(r.shard_name, r.shard_ordinal): r.record for r in rows.collect()}


def expected():
    want = {}
    for name in ("conversations.json", "conversations-10.json", "conversations-11.json", "conversations-12.json"):
        want |= {(name, i): e for i, e in enumerate(json.loads(GOOD[name]))}
    return want


def scanned(spark, paths, split_bytes, **limit):
    read = shards.pieces(fixed_splits(spark, split_bytes).read.text(paths, lineSep="}"))
    return shards.scan(read, **limit)


@pytest.mark.parametrize("split_bytes", [60, 1 << 20])
def test_scan_of_split_files(spark, export, split_bytes):
    records, bad = scanned(spark, [f"{export}/{n}" for n in {**GOOD, **BAD}], split_bytes)
    rows = records.collect()
    got = {(r.shard_name, r.shard_ordinal): r.record for r in rows}
    assert len(got) == len(rows)
    assert {r.shard_name: r.reason for r in bad.collect()} == {name: "MALFORMED_JSON" for name in BAD}
    broken = {k: got.pop(k) for k in list(got) if k[0] == "conversations-002.json"}
    assert {k: json.loads(v) for k, v in got.items()} == expected()
    assert broken == {("conversations-002.json", i): t for i, t in enumerate(['{"a":1}', '{"b":tru}', '{"c":2}'])}


def random_value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.3:
        return {rng.choice(["a", "}", "[", '"', "\\", "é,"]) * rng.randint(1, 3): random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    if depth and kind < 0.5:
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, None, True, -2.5, "", "  }", "\\", '\\"', "}]},", "\\\\}", 'x"}"{', "日}本", "} ] , "])


def test_random_arrays_in_random_splits(spark, tmp_path):
    """Every cut of every array gives the elements that a JSON reader finds."""
    rng = random.Random(7)
    want = {}
    for n in range(14):
        values = [random_value(rng, 4) for _ in range(rng.randint(0, 8))]
        text = rng.choice(["", " \n"]) + "["
        for i, value in enumerate(values):
            text += rng.choice(["", " ", "\n\t"]) + json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
            text += rng.choice(["", "  "]) + ("," if i < len(values) - 1 else "")
        (tmp_path / f"conversations-{n}.json").write_text(text + "]" + rng.choice(["", "\n", "  "]), encoding="utf8")
        want |= {(f"conversations-{n}.json", i): v for i, v in enumerate(values)}
    for split_bytes in (31, 300):
        records, bad = scanned(spark, str(tmp_path), split_bytes)
        rows = records.collect()
        assert len(rows) == len(want) and bad.count() == 0
        assert {(r.shard_name, r.shard_ordinal): json.loads(r.record) for r in rows} == want


def test_nothing_between_commas_is_no_element(spark, tmp_path):
    (tmp_path / "conversations.json").write_text('[ , {"a":1}, ,{"b":"},"} ,\n, 3,, ]')
    for split_bytes in (5, 1000):
        got = elements(scanned(spark, str(tmp_path), split_bytes)[0])
        assert got == {("conversations.json", i): e for i, e in enumerate(['{"a":1}', '{"b":"},"}', "3"])}


def test_ingest(spark, export, tmp_path):
    found = listing.shards_in(listing.list_files(spark, export))
    rows, bad = ingest.ingest_shards(spark, found, str(tmp_path / "rows"))
    counts = {}
    for r in rows.collect():
        counts.setdefault(r.shard_name, {}).setdefault(r.reason, []).append(r.shard_ordinal)
    assert {n: {k: len(v) for k, v in c.items()} for n, c in counts.items()} == {
        "conversations.json": {"UNSUPPORTED_RECORD": 7}, "conversations-10.json": {"UNSUPPORTED_RECORD": 60},
        "conversations-002.json": {"UNSUPPORTED_RECORD": 2, "MALFORMED_RECORD": 1},
        "conversations-11.json": {"UNSUPPORTED_RECORD": 3}, "conversations-12.json": {"UNSUPPORTED_RECORD": 3},
    }
    assert {r.shard_name for r in bad.collect()} == set(BAD)


def test_record_over_many_splits_stays_whole(spark, tmp_path):
    large = json.dumps({"b": ["} " + "x" * 500 + " }"] * 600, "c": {"d": {}}})
    (tmp_path / "conversations.json").write_text(f'[{{"a": 1}},{large},{{"c": 2}}]')
    records, bad = scanned(spark, str(tmp_path), 4096)
    assert elements(records) == {
        ("conversations.json", 0): '{"a": 1}', ("conversations.json", 1): large, ("conversations.json", 2): '{"c": 2}'}
    assert bad.count() == 0


def test_depth_limit(spark, tmp_path):
    (tmp_path / "conversations.json").write_text("[" + '{"a":' * 300 + "1" + "}" * 300 + "]")
    (tmp_path / "conversations-1.json").write_text('[{"a":"' + "{" * 400 + '"},{}]')
    for split_bytes in (50, 1 << 20):
        records, bad = scanned(spark, str(tmp_path), split_bytes, depth_limit=256)
        assert [(r.shard_name, r.reason) for r in bad.collect()] == [("conversations.json", "RESOURCE_LIMIT")]
        assert {name for name, _ in elements(records)} == {"conversations-1.json"}
        records, bad = scanned(spark, str(tmp_path), split_bytes)
        assert bad.count() == 0 and records.count() == 3


def test_deep_record_costs_no_shard(spark, tmp_path):
    """A deep record is refused alone, and the records beside it stay."""
    folder = tmp_path / "deep"
    folder.mkdir()
    deep = '{"a":' * 300 + "1" + "}" * 300
    (folder / "conversations.json").write_text('[{"b":1},' + deep + ',{"c":2}]')
    found = listing.shards_in(listing.list_files(spark, str(folder)))
    rows, bad = ingest.ingest_shards(spark, found, str(tmp_path / "rows"))
    assert bad.count() == 0
    got = sorted((r.shard_ordinal, r.record_bytes) for r in rows.collect())
    assert got == [(0, 7), (1, len(deep)), (2, 7)]


def test_no_text_is_shuffled(spark, export):
    """One shard in many splits: no exchange holds pieces; only parts at the edges of splits meet."""
    records, _ = scanned(spark, f"{export}/conversations-10.json", 150)
    plan = records._jdf.queryExecution().executedPlan().toString()
    exchanges, broadcast = [], None
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if broadcast is not None and depth <= broadcast:
            broadcast = None
        if broadcast is None and "BroadcastExchange" in line:  # below it are the few rows of splits
            broadcast = depth
        if broadcast is None and "Exchange hashpartitioning" in line:
            exchanges.append(line)
    assert len(exchanges) == 1 and "shard_ordinal" in exchanges[0]
    read = shards.pieces(fixed_splits(spark, 150).read.text(f"{export}/conversations-10.json", lineSep="}"))
    summaries = read.mapInArrow(shards._summaries, shards._SUMMARY)
    assert "Exchange" not in summaries._jdf.queryExecution().executedPlan().toString()
    assert summaries.count() > 5


def test_changed_splits_end_the_job(spark, export, monkeypatch):
    """A read that is cut otherwise than the first one fails; it loses nothing unnoticed."""
    path = f"{export}/conversations-10.json"
    narrow = fixed_splits(spark, 150).read.text(path, lineSep="}")
    wide = shards.pieces(fixed_splits(spark, 400).read.text(path, lineSep="}"))
    real = shards.materialize
    calls = []

    def other(df, label):
        calls.append(label)
        return real(wide.mapInArrow(shards._summaries, shards._SUMMARY) if label == "split-summaries" else df, label)

    monkeypatch.setattr(shards, "materialize", other)
    with pytest.raises(Exception, match="changed between two reads"):
        shards.scan(shards.pieces(narrow))[0].collect()
    assert "split-summaries" in calls


def test_marks_skip_escaped_quotes():
    text = rb'["a\\\"b,",{"c\\":1}]'
    at, kind, inside, quotes = shards.marks(np.frombuffer(text, np.uint8))
    outside = [(chr(text[i]), int(k)) for i, k, q in zip(at, kind, inside) if not q]
    assert [c for c, _ in outside] == ["[", ",", "{", "}", "]"]
    assert quotes == 0


def test_listing(spark, export):
    files = listing.list_files(spark, export)
    row = listing.validation(files).first()
    assert (row.shard_count, row.attachment_file_count, row.supported) == (len(GOOD) + len(BAD), 2, True)
    order = listing.shards_in(files).orderBy(listing.shard_order(files["name"])).select("name")
    names = [r.name for r in order.collect()]
    assert names[0] == "conversations.json" and names[-1] == "conversations-015.json"
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_no_shards_is_refused(spark, tmp_path):
    (tmp_path / "other.txt").write_text("x")
    with pytest.raises(ValueError, match="not a supported export"):
        listing.require_supported(listing.list_files(spark, str(tmp_path)))


@pytest.mark.parametrize("split_bytes", [1, 7, 60, 1 << 20])
def test_shards_as_rows_scan_like_files(spark, export, split_bytes):
    texts = spark.createDataFrame(list({**GOOD, **BAD}.items()), "shard_name string, text string").repartition(3)
    records, bad = shards.scan(shards.text_pieces(texts, split_bytes))
    in_files, bad_files = scanned(spark, [f"{export}/{n}" for n in {**GOOD, **BAD}], 1 << 20)
    assert sorted(map(tuple, bad.collect())) == sorted(map(tuple, bad_files.collect()))
    got = elements(records)
    assert got == elements(in_files) and len(got) == records.count() > 60


def test_registered_scan_writes_no_file_per_shard(spark, tmp_path):
    from colloquy.plans import table_queries

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(600)], "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    read = table_queries._shard_pieces(spark, str(tmp_path))
    assert read.select("shard_name").distinct().count() == 60 and len(read.inputFiles()) < 20
    assert table_queries._malformed(spark, str(tmp_path)).count() == 30
