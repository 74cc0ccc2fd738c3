"""Prefixes and hashes of files of any size, and what a refresh stores of attachment files."""

import hashlib
import os

import pytest
from helpers import message, node, record
from test_refresh import write_same_time

from colloquy.operators import attachments as A
from colloquy.plans import refresh
from colloquy.sources import listing, ranges

GIB = 1024**3


@pytest.fixture
def small_values(spark):
    """No file is read as one value: the file source refuses whole files of over a hundred bytes."""
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "100")
    yield
    spark.conf.unset(key)


def tree_hash(data, split):
    """The hash of one file, stated over its bytes."""
    size = len(data)
    pieces, at = [], 0
    while at < size:
        end = data.find(b"}", at)
        end = size if end < 0 else end + 1
        pieces.append((at, data[at:end].removesuffix(b"}") + b"}"))
        at = end
    splits = {}
    for at, piece in pieces:
        # A split also has the piece that starts right at its end, as the reader's rule is.
        splits.setdefault(max(0, at - 1) // split, []).append(piece)
    digests = [(b, hashlib.sha256(b"".join(p)).hexdigest()) for b, p in sorted(splits.items())]
    parts = {}
    for block, digest in digests:
        parts.setdefault(block // ranges.HASH_FAN_OUT, []).append(digest)
    level = [hashlib.sha256("".join(p).encode()).hexdigest() for _, p in sorted(parts.items())]
    root = hashlib.sha256("".join(level).encode()).hexdigest() if level else ""
    return hashlib.sha256(f"{size}:{root}".encode()).hexdigest()


def test_hashes_by_split(spark, tmp_path, small_values):
    texts = {
        "conversations-0.json": b"", "conversations-1.json": b"}", "conversations-2.json": b"a", "conversations-3.json": b"a}",
        "conversations-4.json": b"".join(b'{"i":%d}' % i * (i % 3) for i in range(4000)),
        "conversations-5.json": b"x" * 5000 + b"}" + b"\xff\x00y" * 700, "conversations-6.json": b"}" * 3000,
        "conversations-7 +%20.json": b"a",
    }
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    files = listing.list_files(spark, str(tmp_path))
    got = {r.name: r.content_hash for r in ranges.content_hashes(spark, files, 256).collect()}
    same = got.pop("conversations-7 +%20.json")
    assert same == got["conversations-2.json"] != got["conversations-3.json"]
    texts.pop("conversations-7 +%20.json")
    assert got == {n: tree_hash(d, 256) for n, d in texts.items()}
    # Neither the other files nor the number of cores changes a hash.
    alone = ranges.content_hashes(spark, files.where("name = 'conversations-4.json'"), 256).first()
    assert alone.content_hash == got["conversations-4.json"]
    # One changed byte, of the same size.
    (tmp_path / "conversations-4.json").write_bytes(texts["conversations-4.json"].replace(b'"i":3998', b'"i":3990', 1))
    again = ranges.content_hashes(spark, files.where("name = 'conversations-4.json'"), 256).first()
    assert again.content_hash != alone.content_hash
    assert ranges.content_hashes(spark, files.where("false")).count() == 0


FILES = {
    "file-a b%20.dat": b"%PDF-1.4" + b"x" * 500, "file-b.dat": b"plain " * 30_000, "file-c.dat": b"",
    "FILE-d.DAT": b"RIFF0000WAVE" + b"\0" * 200,
}


def write_files(root):
    root.mkdir(exist_ok=True)
    for name, data in FILES.items():
        (root / name).write_bytes(data)
    # Sparse: the first has over two GiB, the second is over the size that is opened.
    for name, size in (("file-large.dat", 3 * GIB), ("file-huge.dat", 17 * GIB)):
        with open(root / name, "wb") as file:
            file.write(b"\x89PNG\r\n\x1a\n")
            file.truncate(size)


def test_prefixes(spark, tmp_path, small_values):
    write_files(tmp_path)
    root = str(tmp_path)
    listed = listing.attachments_in(listing.list_files(spark, root))
    read = ranges.prefixes(spark, root, listed, 100, 16 * GIB)
    got = {r.name: r.prefix for r in read.collect()}
    assert {n: bytes(got[n]) for n in FILES} == {n: d[:100] for n, d in FILES.items()}
    assert bytes(got["file-large.dat"]) == b"\x89PNG\r\n\x1a\n" + b"\0" * 92 and got["file-huge.dat"] is None
    assert ranges.prefixes(spark, root, listed.where("false"), 100, 16 * GIB).count() == 0


def test_files_too_large_are_not_opened(spark, tmp_path, small_values):
    write_files(tmp_path)
    os.chmod(tmp_path / "file-huge.dat", 0)
    listed = listing.attachments_in(listing.list_files(spark, str(tmp_path)))
    files = refresh.classify_listed(spark, str(tmp_path), listed)
    kinds = {r.name: (r.byte_size, r.detected_mime, r.preview_kind) for r in files.collect()}
    assert kinds == {
        "file-a b%20.dat": (508, "application/pdf", "pdf"), "file-b.dat": (180_000, "text/plain", "text"),
        "file-c.dat": (0, "text/plain", "text"), "FILE-d.DAT": (212, "audio/x-wav", "audio"),
        "file-large.dat": (3 * GIB, "image/png", "unsupported"), "file-huge.dat": (17 * GIB, None, "unsupported"),
    }
    refs = spark.createDataFrame(
        [("k", "c", "n", 0, "file-huge", "Huge", None)],
        "attachment_key string, conversation_key string, node_id string, ordinal bigint, reference string, display_name string, claimed_mime string")
    row = A.resolve_attachments(refs, files).first()
    assert (row.status, row.source_name, row.byte_size, row.preview_kind) == ("rejected", None, 17 * GIB, "unsupported")


def test_a_store_that_only_the_file_source_reads(spark, tmp_path, monkeypatch):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    listed = listing.list_files(spark, str(tmp_path))
    direct = ranges.prefixes(spark, str(tmp_path), listed, 100, 10_000).select("name", "prefix").collect()
    assert not ranges.reachable("nowhere://store/x") and not ranges.reachable(str(tmp_path / "gone"))
    monkeypatch.setattr(ranges, "reachable", lambda root: False)
    source = ranges.prefixes(spark, str(tmp_path), listed, 100, 10_000).select("name", "prefix").collect()
    assert sorted(map(tuple, direct)) == sorted(map(tuple, source))
    assert {r.name for r in direct if r.prefix is None} == {"file-b.dat"}


def test_refresh_reads_large_shards_and_keeps_what_it_classified(spark, tmp_path, monkeypatch, small_values):
    source, target = tmp_path / "in", str(tmp_path / "out")
    write_files(source)
    refer = message("see", metadata={"attachments": [{"id": "file-b", "name": "b"}, {"id": "file-new", "name": "n"}]})
    (source / "conversations.json").write_text("[" + record({"a": node("a", msg=refer)}, "a", id="x") + "]")
    asked = []
    kept = refresh.classify_listed

    def seen(spark, source, listed):
        asked.append(sorted(r.name for r in listed.collect()))
        return kept(spark, source, listed)

    monkeypatch.setattr(refresh, "classify_listed", seen)
    first = refresh.refresh(spark, str(source), target)
    assert (first["read"], first["refused"], first["files_changed"]) == (1, 0, True) and len(asked[0]) == 6
    archive = refresh.open_archive(spark, str(source), target)
    assert archive.files.count() == 6 and len(asked) == 1
    assert sorted(r.status for r in archive.attachments.collect()) == ["available", "missing"]
    links = archive.links.count()

    # A second session reads the tables that the first one derived.
    for name in ("link_nodes", "resolve_attachments"):
        owner = refresh.A if name == "resolve_attachments" else __import__("colloquy.operators.graph", fromlist=[name])
        monkeypatch.setattr(owner, name, lambda *a: pytest.fail("derived again"))
    second = refresh.open_archive(spark, str(source), target)
    assert second.attachments.count() == 2 and second.links.count() == links
    monkeypatch.undo()
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    monkeypatch.setattr(refresh, "classify_listed", seen)

    # Nothing has changed: no commit.  Only attachments have: a commit, and only those are classified.
    again = refresh.refresh(spark, str(source), target)
    assert (again["skipped"], again["files_changed"]) == (1, False) and len(refresh._versions(spark, target)) == 1
    (source / "file-new.dat").write_bytes(b"new")
    (source / "file-c.dat").write_bytes(b"%PDF-1.4")
    (source / "file-large.dat").unlink()
    third = refresh.refresh(spark, str(source), target)
    assert (third["skipped"], third["read"], third["files_changed"]) == (1, 0, True)
    assert asked[1:] == [["file-c.dat", "file-new.dat"]] and len(refresh._versions(spark, target)) == 2
    archive = refresh.open_archive(spark, str(source), target)
    assert {r.name for r in archive.files.collect()} == {*FILES, "file-huge.dat", "file-new.dat"}
    assert archive.files.where("name = 'file-c.dat'").first().detected_mime == "application/pdf"
    assert {r.status for r in archive.attachments.collect()} == {"available"}

    # An empty shard is refused, as any text without an array.
    (source / "conversations-1.json").write_bytes(b"")
    empty = refresh.refresh(spark, str(source), target)
    assert (empty["read"], empty["refused"]) == (1, 1)
    (source / "conversations-1.json").unlink()

    # Same size and time, other content: the hash of the shard tells.
    text = (source / "conversations.json").read_text()
    write_same_time(source / "conversations.json", text.replace("see", "sea"))
    assert refresh.refresh(spark, str(source), target)["read"] == 1
