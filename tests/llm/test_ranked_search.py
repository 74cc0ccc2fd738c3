import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from colloquy.llm import ranked_search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def ranking(docs, items, top=20):
    """The definition, one document at a time: {item: [(doc_id, score), ...]}."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, length = sum(map(bool, sizes)), sum(sizes)
    df = Counter(term for _, c in counted for term in c)
    out = {}
    for item, text in items:
        scores = []
        for (i, c), size in zip(counted, sizes):
            score = 0
            for term in words(text):
                if term in c:
                    m = 100 - 25 + (25 * size * n) // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * (
                        (1000000000 * c[term]) // (1000 * c[term] + 12 * m))
            if score > 0:
                scores.append((i, score))
        out[item] = sorted(scores, key=lambda x: (-x[1], x[0] is not None, x[0]))[:top]
    return out


@pytest.fixture(scope="module")
def items_of(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "item_id long, text string, rank int, score int")

    return make


def check(index_docs, items, docs, asked, top=20, **shards):
    index, documents, _ = ranked_search.build_index(index_docs, **shards)
    got: dict = {}
    for r in ranked_search.search(index, documents, items, top, query_block=7).collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    want = ranking(docs, asked, top)
    for item, rows in want.items():
        assert sorted(got.get(item, [])) == [(n + 1, i, s) for n, (i, s) in enumerate(rows)], item
    assert set(got) <= set(want)
    return got


@pytest.mark.parametrize("shard_docs", [1 << 15, 150])
def test_ranks_equal_the_definition(docs_of, items_of, monkeypatch, shard_docs):
    monkeypatch.setattr(ranked_search, "BLOCK", 8)
    monkeypatch.setattr(ranked_search.best, "__defaults__", (32,))
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdeéñ1") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    weights = [1 / (n + 1) for n in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(900)]
    docs += [(2000 + i, docs[5][1]) for i in range(300)]  # one large group of copies
    docs += [(3000, None), (3001, ""), (3002, "  %%% "), (3003, text(20_000)), (3004, "ONE one-One ONE" * 400), (7, "one again"), (7, "one again")]
    docs += [(None, "one again"), (3005, "x" * 50_000)]
    rng.shuffle(docs)
    asked = [(i, text(rng.randint(1, 30))) for i in range(30)]
    asked += [(100, docs[5][1]), (101, "one ONE again"), (102, "nowhere tobefound"), (103, None), (104, ""), (105, vocabulary[0])]
    asked += [(106, " ".join(vocabulary))]
    got = check(docs_of(docs).selectExpr("*", "1 AS term", "2 AS shard", "3 AS df"), items_of(asked), docs, asked, shard_docs=shard_docs)
    assert 102 not in got and 103 not in got and 104 not in got


def test_empty_tables(docs_of, items_of):
    none = docs_of([(1, "a")]).limit(0)
    index, documents, total = ranked_search.build_index(none)
    assert (documents, total) == (0, 0)
    assert ranked_search.search(index, documents, items_of([(1, "a")])).count() == 0
    index, documents, _ = ranked_search.build_index(docs_of([(1, "a b"), (2, None)]))
    assert ranked_search.search(index, documents, items_of([(1, "a")]).limit(0)).count() == 0


def test_blocks_pack_and_unpack():
    rng = np.random.default_rng(2)
    for spread in (1, 3, 300, 70_000):
        places = np.cumsum(rng.integers(1, spread + 1, 1000))
        tf = np.where(rng.random(1000) < 0.01, 100_000, rng.integers(1, 300, 1000))
        sizes = np.array([128] * 7 + [104])
        begins = np.cumsum(sizes) - sizes
        packed, starts, wide = ranked_search.pack(places[begins], places, tf, sizes)
        meta = np.zeros(8, ranked_search._META)
        meta["first"], meta["last"], meta["start"] = places[begins], places[begins + sizes - 1], starts
        meta["n"], meta["wide"], meta["most"] = sizes - 1, wide, 5
        own = ranked_search.PostingList(meta.tobytes(), packed.tobytes())
        got = [np.concatenate(x) for x in zip(*(own.block(i) for i in range(8)))]
        assert (got[0] == places).all() and (got[1] == tf).all()
        low, high = int(places[100]), int(places[700]) + 1
        assert (own.between(low, high)[0] == places[100:701]).all()
        probe = np.unique(rng.integers(0, places[-1] + 50, 500))
        known = dict(zip(places.tolist(), tf.tolist()))
        assert own.counts(probe).tolist() == [known.get(p, 0) for p in probe.tolist()]


def test_rejected_blocks_stay_packed():
    """Only blocks where a candidate can still win are unpacked."""
    n = 4000
    norms = np.full(n, 100, np.int64)
    meta = np.zeros(-(-n // 128), ranked_search._META)
    places = np.arange(n)
    sizes = np.diff(np.append(np.arange(0, n, 128), n))
    packed, starts, wide = ranked_search.pack(places[::128], places, np.ones(n, np.int64), sizes)
    meta["first"], meta["last"], meta["start"], meta["n"], meta["wide"] = places[::128], places[::128] + sizes - 1, starts, sizes - 1, wide
    meta["most"] = ranked_search.impacts(np.array(1), np.array(100))
    common = ranked_search.PostingList(meta.tobytes(), packed.tobytes())
    rare_places = np.array([5, 6, 7, 3000])
    packed, starts, wide = ranked_search.pack(rare_places[:1], rare_places, np.array([50, 50, 50, 1]), np.array([4]))
    one = np.zeros(1, ranked_search._META)
    one["first"], one["last"], one["n"], one["wide"] = 5, 3000, 3, wide
    one["most"] = ranked_search.impacts(np.array(50), np.array(100))
    rare = ranked_search.PostingList(one.tobytes(), packed.tobytes())
    got, scores = ranked_search.best([(common, 1), (rare, 1000)], norms, 3, 64)
    assert got.tolist() == [5, 6, 7] and scores[0] == scores[2]
    assert set(common.known) == {0}


def test_query_equals_its_sql(spark, docs_of, items_of, tmp_path):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé12") for _ in range(rng.randint(1, 4))) for _ in range(200)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 50))).title()) for i in range(400)] + [(500, None)]
    docs_of(docs).write.parquet(f"{tmp_path}/documents.parquet")
    items_of([(i, ", ".join(rng.choices(vocabulary, k=12))) for i in range(9)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = ranked_search.op11_ranked_search(spark, str(tmp_path))
    want = duck.execute(ranked_search.ORACLE)
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
