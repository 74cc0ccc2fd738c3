"""Ranked lexical search: Block-Max MaxScore over sharded, compressed posting lists.

The index is made in one narrow pass after the collection's statistics are known.  A shard
holds some thousands of documents of one task; its list of a term is cut into blocks of
``BLOCK`` postings, each packed with as many bytes a number as its own numbers need.  The
list keeps for each block its first and last document, where its bytes begin and the
largest impact inside.  Impacts need no term weight, so blocks and bounds are exact and
whole numbers.

A search takes from the index the lists of the terms that are asked for and groups them by
shard.  For each query the lists are sorted by weight times largest impact.  While the
bounds of the first lists together stay below the twentieth score so far, documents that
are only in those can't enter the heap: the other lists are essential and give the
candidates.  A candidate's bound is its score so far plus the block maxima of the other
lists at its place; only blocks in which a candidate survives are unpacked.  The heaps of
all shards are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm.common import stored, table

TOP = 20
BLOCK = 128
# A shard ends at so many documents or bytes of text, whichever comes first.
SHARD_DOCS = 1 << 15
SHARD_BYTES = 24 << 20
# Documents that a query looks at in one step; the heap's threshold rises between steps.
WINDOW = 4096
# Queries that are answered together in one group.
QUERY_BLOCK = 256
# Up to so many different terms of all queries, the terms are broadcast to the index.
BROADCAST_TERMS = 100_000

# A term is a run of ASCII letters, ASCII digits and characters beyond ASCII; A-Z are lower-cased.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_META = np.dtype([("first", "<u4"), ("last", "<u4"), ("most", "<u4"), ("start", "<u4"), ("n", "u1"), ("wide", "u1")])


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, repeats included; a null has none."""
    return text.encode("utf-8").translate(_TERM_BYTES).split() if text else []


def impacts(tf: np.ndarray, length_norm: np.ndarray) -> np.ndarray:
    """What one occurrence count is worth in a document, before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * length_norm)


def statistics(docs: DataFrame, text_column: str = "text") -> tuple[int, int]:
    """Documents with a term, and terms of all documents with repeats: one row a batch, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = total = 0
        for batch in batches:
            counts = [len(terms(text)) for text in batch.column(0).to_pylist()]
            documents, total = documents + sum(map(bool, counts)), total + sum(counts)
        yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([total], pa.int64())], names=["docs", "total"])

    row = docs.select(F.col(text_column).alias("t")).mapInArrow(run, "docs long, total long").agg(
        F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
    return row.docs or 0, row.total or 0


def pack(first: np.ndarray, places: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of consecutive blocks, where each begins, and the widths of its numbers.

    A block's documents are written as distances from its first one, then its counts less
    one, both with the fewest bytes (1, 2 or 4) that hold the largest.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    away, less = places - np.repeat(first, sizes), tf - 1
    widest = [np.maximum.reduceat(values, begins) if len(sizes) else values for values in (away, less)]
    wide = [np.where(w < 1 << 8, 1, np.where(w < 1 << 16, 2, 4)) for w in widest]
    length = sizes * (wide[0] + wide[1])
    starts = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    inside = np.arange(len(places)) - np.repeat(begins, sizes)
    for values, widths, base in ((away, wide[0], starts), (less, wide[1], starts + sizes * wide[0])):
        each, at = np.repeat(widths, sizes), np.repeat(base, sizes) + inside * np.repeat(widths, sizes)
        for byte in range(4):
            has = each > byte
            out[at[has] + byte] = values[has] >> 8 * byte & 255
    return out, starts, wide[0] * 16 + wide[1]


class PostingList:
    """One term's list in one shard: block bounds, and blocks that are unpacked on demand."""

    def __init__(self, meta: bytes, packed: bytes):
        self.meta = np.frombuffer(meta, _META)
        self.last = self.meta["last"].astype(np.int64)
        self.most = self.meta["most"].astype(np.int64)
        self.top = int(self.most.max())
        self.packed = packed
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and counts of one block."""
        if at not in self.known:
            first, _, _, start, n, wide = self.meta[at].tolist()
            n += 1
            a, b = wide >> 4, wide & 15
            away = np.frombuffer(self.packed, f"<u{a}", n, start).astype(np.int64)
            less = np.frombuffer(self.packed, f"<u{b}", n, start + n * a).astype(np.int64)
            self.known[at] = away + first, less + 1
        return self.known[at]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the documents low to high - 1."""
        a, b = int(np.searchsorted(self.last, low)), int(np.searchsorted(self.meta["first"], high))
        if a >= b:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = [self.block(at) for at in range(a, b)]
        places, tf = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]
        a, b = np.searchsorted(places, [low, high])
        return places[a:b], tf[a:b]

    def bounds(self, places: np.ndarray) -> np.ndarray:
        """The block maximum at each place, zero between blocks."""
        at = np.searchsorted(self.last, places)
        inside = np.minimum(at, len(self.last) - 1)
        return np.where((at < len(self.last)) & (self.meta["first"][inside] <= places), self.most[inside], 0)

    def counts(self, places: np.ndarray) -> np.ndarray:
        """The count at each of these ascending places; unpacks only blocks that hold one."""
        out = np.zeros(len(places), np.int64)
        at = np.searchsorted(self.last, places)
        ends = np.flatnonzero(np.diff(at, append=-1)) + 1
        begin = 0
        for end in ends.tolist():
            which = int(at[begin])
            if which < len(self.last):
                own, tf = self.block(which)
                part = places[begin:end]
                found = np.minimum(np.searchsorted(own, part), len(own) - 1)
                out[begin:end] = np.where(own[found] == part, tf[found], 0)
            begin = end
        return out


def best(lists: list[tuple[PostingList, int]], norms: np.ndarray, top: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` places of one shard by score, then place, with score above zero.

    ``lists`` has each term's list and its weight times its repeats in the query.
    """
    lists = sorted(((p, w) for p, w in lists if w > 0), key=lambda x: x[0].top * x[1])
    bound = np.cumsum([p.top * w for p, w in lists])
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = 0
    for low in range(0, len(norms), window):
        # Lists before this one can't lift a document over the heap's least score.
        essential = int(np.searchsorted(bound, least, side="right"))
        if essential == len(lists):
            break
        total = np.zeros(min(window, len(norms) - low), np.int64)
        met = np.zeros(len(total), bool)
        for posting, weight in lists[essential:]:
            at, tf = posting.between(low, low + window)
            total[at - low] += weight * impacts(tf, norms[at])
            met[at - low] = True
        found = np.flatnonzero(met)
        at, score = found + low, total[found]
        if essential:
            ceilings = [weight * posting.bounds(at) for posting, weight in lists[:essential]]
            rest = np.sum(ceilings, axis=0)
            for k in range(essential - 1, -1, -1):
                keep = score + rest > least
                at, score, rest = at[keep], score[keep], rest[keep]
                ceilings = [c[keep] for c in ceilings]
                if not len(at):
                    break
                posting, weight = lists[k]
                here = np.flatnonzero(ceilings[k])
                if len(here):
                    score[here] += weight * impacts(posting.counts(at[here]), norms[at[here]])
                rest = rest - ceilings[k]
        keep = score > least
        places, scores = np.concatenate([places, at[keep]]), np.concatenate([scores, score[keep]])
        if len(places) > top:
            order = np.lexsort((places, -scores))[:top]
            places, scores = places[order], scores[order]
        if len(places) == top:
            least = int(scores.min())
    order = np.lexsort((places, -scores))
    return places[order], scores[order]


class _Shard:
    """Documents gathered for one shard of the index."""

    def __init__(self):
        self.ids: list = []
        self.sizes: list[int] = []
        self.words: list[pa.Array] = []
        self.open: list[bytes] = []
        self.bytes = 0

    def add(self, doc_id, text: str | None) -> None:
        own = terms(text)
        self.ids.append(doc_id)
        self.sizes.append(len(own))
        self.open += own
        self.bytes += len(text or "")
        if len(self.open) > 200_000:
            self.close()

    def close(self) -> None:
        self.words.append(pa.array(self.open, pa.binary()).dictionary_encode())
        self.open = []

    def batches(self, shard: int, documents: int, total: int) -> Iterator[pa.RecordBatch]:
        """Rows ``(shard, term, df, meta, packed)``; the row without a term has the documents' ids and norms."""
        self.close()
        words = pa.chunked_array(self.words).unify_dictionaries()
        vocabulary = words.chunk(0).dictionary
        codes = np.concatenate([c.indices.to_numpy() for c in words.chunks]).astype(np.int64)
        # Places follow the ids, so that equal scores go by id.
        order = np.array(sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0)), np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = np.array(self.sizes, np.int64)
        norms = (75 + (25 * sizes * documents) // max(1, total))[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([None], pa.binary()), pa.array([0], pa.int64()),
             pa.array([norms.astype("<i8").tobytes()], pa.binary()), pa.array([None], pa.binary()),
             pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64()))], names=_INDEX_COLUMNS)
        if not len(codes):
            return
        keys = np.sort(codes * len(order) + np.repeat(place, sizes))
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        tf = np.diff(first, append=len(keys))
        keys = keys[first]
        code, places = keys // len(order), keys % len(order)
        list_start = np.flatnonzero(np.diff(code, prepend=-1))
        df = np.diff(list_start, append=len(code))
        inside = np.arange(len(code)) - np.repeat(list_start, df)
        block_start = np.flatnonzero(inside % BLOCK == 0)
        in_block = np.diff(block_start, append=len(code))
        packed, starts, wide = pack(places[block_start], places, tf, in_block)
        blocks = np.diff(np.searchsorted(block_start, np.append(list_start, len(code))))
        list_block = np.cumsum(blocks) - blocks
        meta = np.zeros(len(block_start), _META)
        meta["first"], meta["last"] = places[block_start], places[block_start + in_block - 1]
        meta["most"] = np.maximum.reduceat(impacts(tf, norms[places]), block_start)
        meta["start"] = starts - np.repeat(starts[list_block], blocks)
        meta["n"], meta["wide"] = in_block - 1, wide
        ends = np.append(starts[list_block], len(packed))
        meta_ends = np.append(list_block, len(meta)) * _META.itemsize
        for at in range(0, len(list_start), 20_000):
            to = min(at + 20_000, len(list_start))
            n = to - at
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard)), vocabulary.take(pa.array(code[list_start[at:to]])), pa.array(df[at:to]),
                 _binaries(meta.view(np.uint8), meta_ends[at:to + 1]), _binaries(packed, ends[at:to + 1]),
                 pa.nulls(n, pa.list_(pa.int64()))], names=_INDEX_COLUMNS)


_INDEX_COLUMNS = ["shard", "term", "df", "meta", "packed", "ids"]
_INDEX = "shard long, term binary, df long, meta binary, packed binary, ids array<long>"


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the stretches of ``data`` between these ends."""
    own = data[ends[0]:ends[-1]]
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(own)])


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shard_docs: int = SHARD_DOCS,
                shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int, int]:
    """The stored index of all terms of all documents, the documents with a term and the terms of all documents."""
    documents, total = statistics(docs, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, text.as_py())
                if len(shard.ids) >= shard_docs or shard.bytes >= shard_bytes:
                    yield from shard.batches(number, documents, total)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield from shard.batches(number, documents, total)

    index = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t")).mapInArrow(run, _INDEX)
    return stored(index, "search-index"), documents, total


def query_terms(queries: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(item, term, repeats)``: each query row's terms; rows that repeat an id are one query, answered once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [terms(text) for text in batch.column(1).to_pylist()]
            items = batch.column(0).take(pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own])))
            yield pa.RecordBatch.from_arrays(
                [items.cast(pa.int64()), pa.array([w for x in own for w in x], pa.binary())], names=["item", "term"])

    rows = queries.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t")).distinct()
    return rows.mapInArrow(run, "item long, term binary").groupBy("item", "term").agg(F.count("*").alias("repeats"))


def search(index: DataFrame, documents: int, queries: DataFrame, top: int = TOP, query_block: int = QUERY_BLOCK,
           id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each query with score above zero.

    Equal scores go by ascending doc_id, a null id first; rows that repeat an id are
    documents of their own.  Queries that share an id are one query with the terms of all
    their different texts.  Null and empty queries find nothing, and other columns don't
    matter.

    A group has the lists of one shard for at most ``query_block`` queries: lists are bounded
    by the shard's size, queries by the block.
    """
    asked = stored(query_terms(queries, id_column, text_column), "search-terms")
    parts = max(1, -(-asked.select("item").distinct().count() // query_block))
    blocked = asked.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
    wanted = asked.select("term").distinct()
    few = wanted.count() <= BROADCAST_TERMS
    lists = index.where("term IS NOT NULL")
    held = stored(lists.join(F.broadcast(wanted) if few else wanted, "term").select("shard", "term", "df", "meta", "packed"), "search-lists")
    df = held.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = blocked.join(df, "term").select("part", "term", F.struct("item", (weight * F.col("repeats")).alias("w")).alias("use"))
    by_term = weighed.groupBy("part", "term").agg(F.collect_list("use").alias("uses"))
    met = held.join(F.broadcast(by_term) if few else by_term, "term").select("shard", "part", "meta", "packed", "uses")
    # Norms and ids of a shard, once for each block of queries.
    about = index.where("term IS NULL").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "meta", "ids")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"item_id": [], "doc_id": [], "score": []}
        if left.num_rows and right.num_rows:
            norms = np.frombuffer(right.column("meta")[0].as_py(), "<i8")
            ids = right.column("ids")[0].values
            by_item: dict = {}
            for meta, packed, uses in zip(*(left.column(n).to_pylist() for n in ("meta", "packed", "uses"))):
                posting = PostingList(meta, packed)
                for use in uses:
                    by_item.setdefault(use["item"], []).append((posting, use["w"]))
            for item, own in by_item.items():
                places, scores = best(own, norms, top)
                out["item_id"] += [item] * len(places)
                out["doc_id"] += ids.take(pa.array(places)).to_pylist()
                out["score"] += scores.tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    heaps = met.groupBy("shard", "part").cogroup(about.groupBy("shard", "part")).applyInArrow(
        run, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, documents, _ = build_index(table(spark, sf_dir, "documents"))
    return search(index, documents, table(spark, sf_dir, "benchmark"))


ORACLE = f"""
WITH words AS (
  SELECT row_number() OVER () AS row_no, doc_id, text FROM documents
),
tokens AS (
  SELECT row_no, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM words WHERE text IS NOT NULL
),
counted AS (SELECT row_no, doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
sized AS (SELECT row_no, sum(tf) AS n FROM counted GROUP BY row_no),
whole AS (SELECT count(*) AS docs, sum(n) AS total FROM sized),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, whole GROUP BY term, docs
),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
),
uses AS (SELECT item_id, term, count(*) AS repeats FROM asked GROUP BY ALL),
scored AS (
  SELECT item_id, row_no, c.doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * docs) // total))))) AS score
  FROM uses JOIN counted c USING (term) JOIN weights USING (term) JOIN sized USING (row_no), whole
  GROUP BY item_id, row_no, c.doc_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row_no) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {TOP}
"""
