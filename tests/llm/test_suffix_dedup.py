import hashlib
import random

import pyarrow as pa
import pytest

from colloquy.llm import common, suffix_dedup, windows

SIZE = 50


def brute(rows):
    """Every window in a set of those of smaller documents."""
    texts = sorted(((r[0], (r[1] or "").encode()) for r in rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = {}, []
    for doc, text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - SIZE + 1):
            first = seen.setdefault(text[i:i + SIZE], doc)
            if first != doc and first is not None:
                gone[i:i + SIZE] = b"\1" * SIZE
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((doc, len(text), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs, digests=True).collect()), key=str)


def sample():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(rng.randint(0, 90)))
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            text = text[:at] + passage[rng.randint(0, 20):][: rng.randint(40, 200)] + text[at:]
        rows.append((i, text))
    rows += [(70, rows[3][1]), (71, rows[3][1][:-1] + "!"), (72, "ab" * 200), (73, "ab" * 100), (74, "a" * 49), (75, "a" * 50),
             (76, "a" * 51), (77, None), (78, ""), (None, passage), (None, passage)]
    return rows


@pytest.mark.parametrize("hot", [4000, 30])
def test_matches_brute_force(docs_of, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "GROUP_ENTRIES", 300)
    monkeypatch.setattr(suffix_dedup, "CHUNK_HOT", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", hot)
    rows = sample()
    assert found(docs_of(rows)) == brute(rows)


def test_text_longer_than_a_buffer(docs_of, monkeypatch):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_300_000))
    cut = 1_000_000
    rows = [(1, long), (2, "x" + long[cut:cut + 120_000] + "y"), (3, long)]
    got = {r[0]: r for r in found(docs_of(rows))}
    assert got[1][2:4] == (0, 0) and got[2][1:4] == (120_002, 120_000, 1) and got[3][2] == len(long)


def test_workers_keep_little_memory(monkeypatch):
    # Seeds of the four hashes; the tables of all stay in every worker process.
    assert sum(x.nbytes for seed in (1, 7, 11, 13) for x in windows._powers(seed)) < 16 << 20
    calls = []
    monkeypatch.setattr(common, "_give_back", lambda: calls.append(1))
    one = pa.table({"a": [1]})
    assert common.tidy_group(lambda rows: rows)(one) is one and common.tidy_cogroup(lambda a, b: b)(None, one) is one
    assert list(common.tidy(iter)([1, 2])) == [1, 2] and len(calls) == 4


def test_empty_table_and_clashing_columns(spark, docs_of):
    assert found(docs_of(sample()).limit(0)) == []
    docs = docs_of(sample()).selectExpr("*", "1 AS kind", "2 AS chunk", "3 AS data", "4 AS c0")
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = {r.doc_id: r.text for r in out.collect()}
    assert by_id[70] == "" and by_id[77] is None and by_id[76] == "a"[:0]


def test_window_sample_depends_on_the_window_only():
    import numpy as np

    data = np.frombuffer(random.Random(2).randbytes(400), np.uint8)
    keys = windows.Rolling(data, 1).every(20)
    whole = windows.window_samples(keys, 31)
    for start in range(0, 300, 7):
        part = windows.Rolling(data[start:start + 50], 1).every(20)
        assert windows.window_samples(part, 31)[0] == whole[start] - start


def test_digits_take_one_hash_table_a_text_and_sort_ties_only(monkeypatch):
    made = []

    class Counted(windows.Rolling):
        def __init__(self, data, seed):
            made.append(seed)
            super().__init__(data, seed)

    monkeypatch.setattr(suffix_dedup, "Rolling", Counted)
    rows = [(i, t) for i, t in sample() if i is not None]
    ids, texts = (pa.chunked_array([pa.array(c)]) for c in zip(*rows))
    found = suffix_dedup.Suffixes(ids, texts, SIZE)
    assert len(made) == sum(len((t or "").encode()) >= SIZE for _, t in rows)
    key, run, owner, place, _ = found.digits()
    pairs = list(zip(key.tolist(), run.tolist()))
    assert pairs == sorted(set(zip(found.key.tolist(), found.run.tolist())))
    assert (key[place] == found.key).all() and (run[place] == found.run).all()
    least = {}
    for d, k, r in zip(found.ids[found.doc].tolist(), found.key.tolist(), found.run.tolist()):
        least[k, r] = min(d, least.get((k, r), d))
    assert owner.tolist() == [least[p] for p in pairs] and len(set(key.tolist())) < len(key)


def chunk_of(rows):
    return suffix_dedup.Suffixes(*(pa.chunked_array([pa.array(c)]) for c in zip(*rows)), SIZE)


def test_windows_are_ordered_a_share_of_the_buckets_at_a_time(monkeypatch):
    import numpy as np

    found = chunk_of([(i, t) for i, t in sample() if i is not None])
    asked = np.arange(len(found.doc)) % 3 > 0

    def windows_of(share):
        monkeypatch.setattr(suffix_dedup, "SHARE_WINDOWS", share)
        shares = list(suffix_dedup._windows(found, asked, 7))
        distinct = [row for a, b, owner, bucket, *_ in shares for row in zip(bucket.tolist(), a.tolist(), b.tolist(), owner.tolist())]
        each = sorted(row for a, b, owner, bucket, doc, start, place in shares
                      for row in zip(doc.tolist(), start.tolist(), a[place].tolist(), b[place].tolist()))
        return len(shares), sorted(distinct), each

    one, many = windows_of(10**9), windows_of(300)
    assert (one[0], many[0]) == (1, 7) and one[1:] == many[1:]
    raw = {(d, s): bytes(found.texts[d][s:s + SIZE]) for d, s, _, _ in one[2]}
    assert len({(a, b) for _, _, a, b in one[2]}) == len(set(raw.values())) == len(one[1])
    assert len(raw) == sum((found.high - found.low)[asked])


def test_memory_of_a_chunk(monkeypatch):
    import tracemalloc

    import numpy as np

    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("abcdefgh ", k=20_000))) for i in range(50)]
    monkeypatch.setattr(suffix_dedup, "SHARE_WINDOWS", 100_000)
    found = chunk_of(rows)
    tracemalloc.start()
    try:
        chunk_of(rows[:1])
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        for n, _ in enumerate(suffix_dedup._windows(found, np.ones(len(found.doc), bool), 40)):
            pass
        peak = tracemalloc.get_traced_memory()[1] - held
    finally:
        tracemalloc.stop()
    # A million windows took over 100 bytes each when all were ordered at once.
    assert n > 5 and peak < 40 * 1_000_000


def test_texts_of_a_chunk_are_views():
    texts = pa.chunked_array([pa.array(["x", None, "", "é" * 30]).slice(1), pa.array([], pa.string()), pa.array(["ab"], pa.string())])
    assert [bytes(t) for t in suffix_dedup.byte_views(texts)] == [b"", b"", ("é" * 30).encode(), b"ab"]
    assert all(isinstance(t, memoryview) for t in suffix_dedup.byte_views(texts.cast(pa.large_string())))


def test_small_batches(spark, docs_of):
    docs = docs_of([(i, "a") for i in range(2500)]).coalesce(1)
    rows = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    with common.small_batches(spark):
        assert max(r.n for r in docs.mapInArrow(rows, "n long").collect()) <= 1000
    assert max(r.n for r in docs.mapInArrow(rows, "n long").collect()) > 1000
