"""Best-fit packing of token pieces, planned on the histogram of lengths.

The plan is made over counts of lengths on the driver: a thousand numbers, whatever the
corpus.  Pieces then take planned slots by their rank within their length.  Ranks come
from counts of small sub-groups, so a very common length is never in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.bpe import codec, text_slices
from colloquy.llm.common import small_batches, stored, table, tidy

SIZE = 1024
END = 2
SUB_ROWS = 250_000


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of n ids: only longer ones are cut, the first may be shorter."""
    head = n % size
    starts = ([0] if head else []) + list(range(head, n, size))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, id_column: str = "doc_id",
           text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of every document: its ids and the end mark, cut to size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = codec(vocabulary), np.array([END], "<i4")
        for part in text_slices(batches):
            rows, arrays = [], []
            flat, ends = own.encode_column(part.column(1))
            for doc, first, last in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                ids = np.concatenate((flat[first:last].astype("<i4", copy=False), end))
                for piece, (start, length) in enumerate(cut(len(ids), size)):
                    own_ids = ids[start:start + length]
                    rows.append((doc, piece, start, length, zlib.crc32(own_ids)))
                    if with_ids:
                        arrays.append(own_ids)
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in
                       enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(arrays, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        own.forget()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInArrow(tidy(run), schema)


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, int]:
    """Best fit over counts, longest first, and the number of sequences.

    Rows ``(length, first rank, per sequence, first sequence, offset)``: ranks from the
    first on fill the sequences from the first on, so many to each.  Sequences with
    equal contents are one class; a length splits one class at most and opens two, so
    the plan stays small.
    """
    free: list[int] = []
    classes: dict[int, list[tuple[int, tuple]]] = {}

    def put(room: int, count: int, contents: tuple) -> None:
        if count:
            if room not in classes:
                classes[room] = []
                insort(free, room)
            classes[room].append((count, contents))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                room = free[at]
                count, contents = classes[room].pop()
                if not classes[room]:
                    del classes[room]
                    free.pop(at)
            else:
                room, contents = size, ()
                count = -(-left // (size // length))
            each = room // length
            full = min(count, left // each)
            put(room - each * length, full, (*contents, (length, each)))
            left -= full * each
            some = left if full < count else 0
            if some:
                put(room - some * length, 1, (*contents, (length, some)))
                left = 0
            put(room, count - full - bool(some), contents)
    rows, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for room in sorted(classes):
        for count, contents in classes[room]:
            offset = 0
            for length, each in contents:
                rows.append((length, taken[length], each, sequence, offset))
                taken[length] += count * each
                offset += length * each
            sequence += count if contents else 0
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def slots(ranked: DataFrame, planned: np.ndarray) -> DataFrame:
    """Add sequence_id and offset to rows with a length and a rank within it."""
    starts = planned[:, 0] << 44 | planned[:, 1]
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            step = planned[np.searchsorted(starts, length << 44 | rank, side="right") - 1] if len(rank) else planned[:0]
            nth = rank - step[:, 1]
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(step[:, 3] + nth // step[:, 2]), pa.array(step[:, 4] + nth % step[:, 2] * length)],
                names=[*kept.schema.names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(tidy(run), schema)


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, id_column: str = "doc_id",
         text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked).

    Null and empty texts are one piece, the end mark.  Repeated rows are packed as often
    as they occur; other columns don't matter.  An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        cut_up = stored(pieces(docs, size, vocabulary, id_column, text_column, with_ids), "pack-pieces")
    histogram = {r.length: r.n for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned, _ = plan(histogram, size)
    subs = max(16, sum(histogram.values()) // SUB_ROWS)
    dealt = cut_up.withColumn("sub", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(subs)))
    before = Window.partitionBy("length").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "sub").agg(F.count("*").alias("n")).select(
        "length", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("length", "sub").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(within)).join(firsts, ["length", "sub"]).select(
        *cut_up.columns, (F.col("first") + F.col("nth") - 1).alias("rank")
    )
    return slots(ranked, planned)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return pack(docs)
