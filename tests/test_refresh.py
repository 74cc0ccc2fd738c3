"""Incremental refresh and the file stream."""

import os

import pytest
from helpers import record, tree

from colloquy import schemas
from colloquy.plans import refresh
from colloquy.streaming import ingest


def shard(*titles):
    return "[" + ",".join(record(tree({"a": None, "b": "a"}), "b", id=t, title=t) for t in titles) + "]"


def titles(spark, target):
    return sorted(r.title for r in refresh.read_archive(spark, target).collect() if r.title)


def write_same_time(path, text):
    stat = os.stat(path)
    path.write_text(text)
    os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))


def test_refresh(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i, names in enumerate((("a1", "a2"), ("b1",), ("c1",))):
        (source / f"conversations-{i}.json").write_text(shard(*names))
    (source / "file-1.dat").write_text("x")
    first = refresh.refresh(spark, str(source), target)
    assert (first["skipped"], first["read"], first["pruned"]) == (0, 3, 0)
    assert titles(spark, target) == ["a1", "a2", "b1", "c1"]

    again = refresh.refresh(spark, str(source), target)
    assert (again["skipped"], again["read"]) == (3, 0)
    assert len(refresh._versions(spark, target)) == 1

    # Same size and time but other content; one shard breaks; one goes away.
    write_same_time(source / "conversations-0.json", shard("a1", "a3"))
    (source / "conversations-1.json").write_text("[{")
    (source / "conversations-2.json").unlink()
    third = refresh.refresh(spark, str(source), target)
    assert (third["skipped"], third["read"], third["refused"], third["pruned"]) == (0, 2, 1, 1)
    assert titles(spark, target) == ["a1", "a3", "b1"]
    archive = refresh.open_archive(spark, str(source), target)
    assert archive.files.count() == 1 and archive.conversations.count() == 3

    monkeypatch.setattr(schemas, "PROJECTION_VERSION", "next")
    assert refresh.refresh(spark, str(source), target)["skipped"] == 0


def test_a_changing_source_is_not_committed(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "conversations.json").write_text(shard("a"))
    kept = refresh.store_run

    def touch(*args):  # a shard appears while the others are read
        (source / "conversations-1.json").write_text("[]")
        return kept(*args)

    monkeypatch.setattr(refresh, "store_run", touch)
    with pytest.raises(RuntimeError, match="nothing was committed"):
        refresh.refresh(spark, str(source), target)
    assert refresh._versions(spark, target) == []


def test_file_stream(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    (source / "conversations.json").write_text(shard("a"))
    (source / "conversations-x.json").write_text(shard("no"))
    ingest.ingest_stream(spark, str(source), target, state).awaitTermination()
    (source / "conversations-1.json").write_text(shard("b", "c"))
    ingest.ingest_stream(spark, str(source), target, state).awaitTermination()
    assert titles(spark, target) == ["a", "b", "c"]
    assert refresh.read_manifest(spark, target).count() == 2


def test_two_streams_into_one_archive(spark, tmp_path):
    """Each stream counts its batches from zero; neither writes where the other did."""
    target = str(tmp_path / "out")
    for name, title in (("one", "a"), ("two", "b")):
        source = tmp_path / name
        source.mkdir()
        (source / f"conversations-{ord(title)}.json").write_text(shard(title))
        ingest.ingest_stream(spark, str(source), target, str(tmp_path / f"state-{name}")).awaitTermination()
    assert titles(spark, target) == ["a", "b"]
    assert refresh.read_manifest(spark, target).select("run").distinct().count() == 2


def test_export_of_nothing_and_two_writers(spark, tmp_path):
    source, target = tmp_path / "empty", str(tmp_path / "stored")
    source.mkdir()
    (source / "conversations.json").write_text("[]")
    refresh.refresh(spark, str(source), target)
    assert refresh.open_archive(spark, str(source), target).conversations.count() == 0
    manifest = refresh.read_manifest(spark, target)
    manifest.write.parquet(f"{target}/manifest/v=2")
    refresh.write_manifest(manifest, target)
    assert refresh._versions(spark, target) == [1, 2, 3]
