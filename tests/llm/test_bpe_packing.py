import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from colloquy.llm import bpe, packing

TEXTS = [
    "Hello world, it's 12 o'clock!!", "", None, " leading", "trailing  ", "a\n\n b\t\tc \n", "é" * 300, "日本語 text ½ ² Ⅷ",
    "x<|endoftext|>  y", "<|endoftext|>", " nbsp em", "\x1c\x85z", "z" * 4000, "ab" * 700, "😀👩‍👩‍👧 %%% ***", "'s 'S 'll",
    "mixed " * 3000, "�\x00\x07", "ъ" * 60 + " " * 70 + "end",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def test_ids_and_text_equal_the_library(library):
    own = bpe.codec()
    rng = random.Random(1)
    letters = "  \n\t'sdtmrevl09éß½ñ%!|日́ "
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, own.encode_batch(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words_merge_like_short_ones():
    own = bpe.codec()
    rng = random.Random(2)
    for n in (1, 2, 3, 47, 48):
        word = bytes(rng.choice(b"etaoin") for _ in range(n))
        assert own.merge_equal([word, word]) == [own.merge_long(word)] * 2


def test_tables_of_known_words_are_emptied(monkeypatch, library):
    own = bpe.Codec(bpe.default_vocabulary())
    monkeypatch.setattr(bpe, "CACHED_WORDS", 5)
    for i in range(20):
        text = f"word{i} other{i} word{i - 1}"
        assert own.encode(text) == library.encode(text).ids
    assert len(own.words) + len(own.spaced) < 40


def test_columns_equal_the_library(library):
    own, rng = bpe.Codec(bpe.default_vocabulary()), random.Random(3)
    letters = " eéª_µ'9.,\n"
    texts = TEXTS + [" ", "a ", "\na"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for column in (texts, [None, ""], [], [t for t in texts if t and t.isascii()]):
        ids, ends = own.encode_column(pa.array(column, pa.string()))
        assert len(ends) == len(column) + 1 and ends[-1] == len(ids)
        for text, start, end in zip(column, ends, ends[1:]):
            assert ids[start:end].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_words_of_a_column_are_merged_once_and_not_kept(monkeypatch):
    own, merged = bpe.Codec(bpe.default_vocabulary()), []
    rows = own.merge_rows
    monkeypatch.setattr(own, "merge_rows", lambda raw: merged.extend(map(bytes, raw)) or rows(raw))
    own.encode_column(pa.array([f"some word{'abc'[i % 3]} again, some word{'abc'[i % 3]}" for i in range(500)]))
    assert len(merged) == len(set(merged)) == 7 and not own.words and not own.spaced


def test_slices_of_texts_hold_every_row(monkeypatch):
    monkeypatch.setattr(bpe, "COLUMN_BYTES", 10)
    texts = ["abc", None, "d" * 30, "", "efgh", "ijkl", "mnop", "é" * 4]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["i", "t"])
    slices = list(bpe.text_slices([batch.slice(0, 0), batch]))
    assert [t for s in slices for t in s.column(1).to_pylist()] == texts
    assert all(s.num_rows == 1 or sum(len((t or "").encode()) for t in s.column(1).to_pylist()) <= 10 for s in slices)


def test_operators(docs_of, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])]
    docs = docs_of(rows).selectExpr("*", "1 AS ids", "2 AS n_tokens", "3 AS i")
    got = {r.doc_id: r for r in bpe.round_trips(docs).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encoded(docs).collect()}
    texts = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs)).collect()}
    for i, text in enumerate(TEXTS):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[i] == want and got[i].n_tokens == len(want)
        assert texts[i] == library.decode(want, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()
    assert bpe.round_trips(docs).count() == len(rows) and bpe.round_trips(docs.limit(0)).count() == 0


def check_plan(lengths, size):
    planned, sequences = packing.plan(Counter(lengths), size)
    places = []
    for at, (length, first, each, start, offset) in enumerate(planned.tolist()):
        later = [r[1] for r in planned.tolist()[at + 1:] if r[0] == length]
        count = (later[0] if later else Counter(lengths)[length]) - first
        places += [(start + i // each, offset + i % each * length, length) for i in range(count)]
    assert Counter(p[2] for p in places) == Counter(lengths)
    at = {}
    for sequence, offset, length in sorted(places):
        assert offset == at.get(sequence, 0)
        at[sequence] = offset + length
    assert sorted(at) == list(range(sequences)) and max(at.values()) <= size
    return sequences


def test_plan_is_gapless_and_tight():
    rng = random.Random(3)
    for size in (8, 64, 1024):
        for _ in range(30):
            lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 300))]
            lengths += [rng.randint(1, size)] * rng.randint(0, 500)
            free = []
            for length in sorted(lengths, reverse=True):  # best fit one by one
                fits = [i for i, room in enumerate(free) if room >= length]
                if fits:
                    free[min(fits, key=lambda i: free[i])] -= length
                else:
                    free.append(size - length)
            assert check_plan(lengths, size) == len(free)
    assert packing.plan({}, 8)[1] == 0


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)] and packing.cut(1, 8) == [(0, 1)]


def test_pack(docs_of, library, monkeypatch):
    monkeypatch.setattr(packing, "SUB_ROWS", 5)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "bc", "def"]) for _ in range(rng.randint(0, 90)))) for i in range(80)]
    rows += [(100 + i, "same text here") for i in range(60)] + [(200, None), (201, "long " * 500), (7, "again"), (7, "again")]
    docs = docs_of(rows).selectExpr("*", "1 AS piece", "2 AS length", "3 AS sub")
    out = packing.pack(docs, size=32, with_ids=True).collect()
    at = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0) and r.length == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 32
    for i, text in dict(rows).items():
        want = library.encode(text or "", add_special_tokens=False).ids + [2]
        if i != 7:
            own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
            assert [x for r in own for x in r.ids] == want and [r.start for r in own] == [s for s, _ in packing.cut(len(want), 32)]
    assert sum(r.doc_id == 7 for r in out) >= 3
    assert packing.pack(docs.limit(0)).count() == 0
