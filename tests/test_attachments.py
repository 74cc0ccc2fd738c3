"""Signatures, matching and names."""

import struct

import pytest
from pyspark.sql import functions as F

from colloquy.functions.images import jpeg_size
from colloquy.operators import attachments as A

PNG = bytes.fromhex("89504E470D0A1A0A0000000D49484452")


def png(w, h):
    return PNG + struct.pack(">II", w, h)


def jpeg(w, h):
    return bytes.fromhex("FFD8FFE000044A46FFC0001108") + struct.pack(">HH", h, w) + bytes(11)


FILES = {
    "png": (png(1, 1), None, ("image/png", "png", "image")),
    "png_big": (png(8192, 8192), None, ("image/png", "png", "unsupported")),
    "png_zero": (png(0, 5), None, ("image/png", "png", "unsupported")),
    "jpeg": (jpeg(640, 480), None, ("image/jpeg", "jpg", "image")),
    "jpeg_cut": (b"\xff\xd8\xff\xe0\x7f", None, ("image/jpeg", "jpg", "unsupported")),
    "wav": (b"RIFF0000WAVE", None, ("audio/x-wav", "wav", "audio")),
    "mp4": (b"\0\0\0\x18ftypisom", None, ("video/mp4", "mp4", "video")),
    "pdf": (b"%PDF-1.4", None, ("application/pdf", "pdf", "pdf")),
    "gif": (b"GIF89a", None, ("image/gif", "gif", "unsupported")),
    "webp": (b"\0\0\0\0\0\0\0\0WEBP", None, ("image/webp", "webp", "unsupported")),
    "flac": (b"fLaC", None, ("audio/x-flac", "flac", "audio")),
    "text": ("héllo\n".encode(), None, ("text/plain", "txt", "text")),
    "text_big": (b"plain", 2 * 1024 * 1024 + 1, ("text/plain", "txt", "unsupported")),
    "wav_big": (b"RIFF0000WAVE", 64 * 1024 * 1024 + 1, ("audio/x-wav", "wav", "unsupported")),
    "controls": (b"ab\x01", None, (None, None, "unsupported")),
    "few_controls": (b"a" * 19 + b"\x01", None, ("text/plain", "txt", "text")),
    "nul": (b"a" * 50 + b"\0", None, (None, None, "unsupported")),
    "bad_utf8": (b"\xc3(", None, (None, None, "unsupported")),
    "empty": (b"", None, ("text/plain", "txt", "text")),
}


def test_classification(spark):
    rows = [(f"d/{n}", len(b) if size is None else size, bytearray(b)) for n, (b, size, _) in FILES.items()]
    frame = spark.createDataFrame(rows, "path string, length bigint, content binary")
    got = {r.name: (r.detected_mime, r.detected_extension, r.preview_kind) for r in A.classify_files(frame).collect()}
    assert got == {n: want for n, (_, _, want) in FILES.items()}
    texts = {r.name: r.text for r in A.read_text_files(frame).collect()}
    assert texts["text"] == "héllo\n" and "nul" not in texts and texts["text_big"] == "plain"


def test_jpeg_walk():
    assert jpeg_size(jpeg(640, 480)) == (640, 480)
    assert jpeg_size(b"\xff\xd8") is None and jpeg_size(None) is None and jpeg_size(b"\xff\xd8\xff\xc0\x00\x03\x00") is None


NAMES = [
    ("../Synthetic\r\nname.txt", "text/plain", None, "text", None, "_Syntheticname.txt"),
    ("Attachment", "audio/wav", None, "audio", None, "Audio attachment.wav"),
    ("Attachment", "audio/wav", None, "audio", 1, "Audio attachment 2.wav"),
    ("Attachment", "audio/wav", None, "unsupported", None, "Audio attachment.wav"),
    ("Quarterly recording.dat", "audio/wav", None, "audio", None, "Quarterly recording.wav"),
    ("Not really a photo.jpg", "application/pdf", None, "pdf", None, "Not really a photo.pdf"),
    ("results.csv", "text/plain", None, "text", None, "results.csv"),
    ("plain.wav", "text/plain", None, "text", None, "plain.txt"),
    ("active-script.sh", "text/plain", None, "text", None, "active-script.txt"),
    ("unknown.exe", "application/octet-stream", None, "unsupported", None, "unknown.bin"),
    ("report.exe", None, None, "missing", None, "report.bin"),
    ("photo.JPEG", "image/jpeg", "jpg", "image", None, "photo.JPEG"),
    ("download", "application/zip", "zip", "unsupported", 0, "Archive attachment 1.zip"),
    ('a"b.png', "image/png", "png", "image", None, "a_b.png"),
    (" . ", None, None, "missing", 2, "Missing attachment 3.bin"),
]


def test_names(spark):
    rows = spark.createDataFrame(
        [(i, *row[:5]) for i, row in enumerate(NAMES)], "i int, v string, m string, e string, k string, o int"
    )
    columns = [F.col(c) for c in "vmek"]
    numbered = A.attachment_name(*columns, F.col("o"))
    plain = A.attachment_name(*columns, None)
    got = rows.select("i", F.when(F.col("o").isNull(), plain).otherwise(numbered).alias("name")).orderBy("i").collect()
    assert [r.name for r in got] == [row[5] for row in NAMES]


def test_long_unicode_name(spark):
    rows = spark.createDataFrame([("é" * 180 + " report",)], "v string")
    name = rows.select(A.attachment_name(F.col("v"), F.lit("text/plain"), F.lit(None).cast("string"), F.lit("text"), None)).first()[0]
    assert name.endswith(".txt") and len(name.encode()) <= 240 and set(name[:-4]) == {"é"}


def refs(spark, rows):
    return spark.createDataFrame(
        [(f"k{i}", "c", "n", i, ref, name, None) for i, (ref, name) in enumerate(rows)],
        "attachment_key string, conversation_key string, node_id string, ordinal bigint, reference string, display_name string, claimed_mime string",
    )


def test_matching_order_and_case(spark):
    names = ("file-a.dat", "FILE-B.DAT", "File-c.dat", "file-C.dat", "file_d.dat", "file-pic.dat")
    files = spark.createDataFrame([(n,) for n in names], "name string")
    asked = [
        ("file-service://file-a?x#y", "z"), ("file-b", "z"), ("file-c", "z"), (None, "d"), ("../../outside", "z"),
        ("nope", "pic"), ("file-C", "z"), ("x\\y:file-a.dat", "z"),
    ]
    got = {r.attachment_key: r.source_name for r in A.match_files(refs(spark, asked), files).collect()}
    assert got == {
        "k0": "file-a.dat", "k1": "FILE-B.DAT", "k3": "file_d.dat", "k5": "file-pic.dat", "k6": "file-C.dat", "k7": "file-a.dat",
    }


@pytest.mark.parametrize("size, status, source", [(5, "available", "file-a.dat"), (16 * 1024**3 + 1, "rejected", None)])
def test_status(spark, size, status, source):
    files = spark.createDataFrame(
        [("file-a.dat", size, "video/mp4", "mp4", "video")],
        "name string, byte_size bigint, detected_mime string, detected_extension string, preview_kind string",
    )
    row = A.resolve_attachments(refs(spark, [("file-a", "Big one")]), files).first()
    assert (row.status, row.source_name, row.byte_size) == (status, source, size)
    assert row.display_name == ("Big one.mp4" if source else "Big one.bin")


def test_text_whose_prefix_ends_inside_a_character(spark):
    rows = []
    for i, (char, shift) in enumerate([("é", 1), ("日", 1), ("日", 2), ("😀", 1), ("😀", 2), ("😀", 3)]):
        text = "a" * (65_536 - shift) + char + " end"
        rows.append((f"e/file-{i}.dat", len(text.encode()), bytearray(text.encode())))
    rows.append(("e/file-9.dat", 70_000, bytearray(b"a" * 65_530 + b"\xff\xfe" + b"a" * 4_468)))
    files = spark.createDataFrame(rows, "path string, length bigint, content binary")
    kinds = {r.name: r.preview_kind for r in A.classify_files(files).collect()}
    assert kinds == {**{f"file-{i}.dat": "text" for i in range(6)}, "file-9.dat": "unsupported"}
    assert A.read_text_files(files).count() == 6


def test_text_is_judged_by_the_control_bytes_it_has(spark):
    cases = [b"plain", b"", "日本語 é".encode(), b"a" * 19 + b"\x01", b"a" * 18 + b"\x01", "é".encode() * 19 + b"\x01\x7f",
             b"ok\x00", b"\xff\xfe bad", b"\t\n\r" * 9, b"\x1b" * 3]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, prefix binary")
    judged = A.looks_like_text(F.col("prefix"))
    got = [r.t for r in rows.select("i", judged.alias("t")).orderBy("i").collect()]
    assert got == [True, True, True, True, False, True, False, False, True, False]
    # No pass replaces every ordinary character: whole texts go through here.
    assert "[^" not in str(judged)
