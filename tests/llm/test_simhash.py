import random

import numpy as np
import pytest
import xxhash

from colloquy.llm import components, near_copies, simhash


def plain_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def closure(ids, linked):
    label = dict(zip(ids, ids))
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            least = min(label[a], label[b])
            if (label[a], label[b]) != (least, least):
                label[a] = label[b] = least
                moved = True
    return label


def sample():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append((3 * i, " ".join(text)))
        if i % 4 == 0 and len(text) > 30:
            text[rng.randrange(len(text))] = "changed"
            rows.append((3 * i + 1, " ".join(text)))
    return rows + [(900, None), (901, "\t \n"), (902, "One"), (903, "one"), (904, "two words"), (905, "a b c " * 9000)]


def test_fingerprint_by_definition():
    for _, text in sample():
        for size in (2, 3, 5):
            if len(text or "") < 5000:
                assert simhash.fingerprint(text, size) == plain_fingerprint(text, size)


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5, 6])
def test_masks_cover_every_pair_within_the_radius(radius):
    rng = random.Random(radius)
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= 32
    for _ in range(2000):
        differing = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(differing & m == 0 for m in masks)


@pytest.mark.parametrize("limit", [64, 1])
def test_components_by_brute_force(spark, docs_of, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", limit)
    rng = random.Random(3)
    marks = [rng.getrandbits(64) for _ in range(40)]
    for m in list(marks):
        marks += [m ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(2)]
    marks = list(dict.fromkeys(marks))
    frame = spark.createDataFrame([(simhash._signed(m), i) for i, m in enumerate(marks)], "fp long, rep long")
    edges = [(r.a, r.b) for r in simhash.near_links(frame, 2).collect()]
    true = [(i, j) for i in range(len(marks)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 2]
    ids = range(len(marks))
    assert closure(ids, edges) == closure(ids, true)


def test_whole_operator(docs_of):
    rows = sample()
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(rows)).collect()}
    marks = {i: simhash.fingerprint(t, 3) for i, t in rows}
    true = closure(list(marks), [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 2])
    assert {i: r.component_id for i, r in got.items()} == true
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == marks


def test_empty_null_ids_and_clashes(spark, docs_of):
    assert simhash.near_duplicates(docs_of(sample()).limit(0)).count() == 0
    docs = docs_of([(None, "x y z"), (5, "x y z"), (5, "x y z"), (None, "alone here now")]).selectExpr("*", "1 AS fp", "2 AS rep", "3 AS kept_id")
    rows = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert rows == [(5, 5), (5, 5), (None, 5), (None, None)]
    assert near_copies.stage(spark, docs, "").columns == docs.columns
    assert near_copies.stage(spark, docs, "").count() == 4


@pytest.mark.parametrize("limit", [64, 1])
def test_near_copies_by_brute_force(docs_of, monkeypatch, limit):
    monkeypatch.setattr(near_copies, "BUCKET_PAIRS", limit)
    monkeypatch.setattr(near_copies, "BLOCK", 2)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(12):
        text = [rng.choice(words) for _ in range(200)]
        for j in range(4):
            copy = list(text)
            for _ in range(j):
                copy[rng.randrange(200)] = "new"
            rows.append((10 * i + j, " ".join(copy)))
    rows += [(500, None), (501, " "), (502, "short"), (503, "short")]
    sets = {i: near_copies.shingle_set(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and (
        (len(sets[a]) == len(sets[b]) and (sets[a] == sets[b]).all()) or near_copies._similar(sets[a], sets[b], 0.8))]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs_of(rows)).collect()}
    assert got == closure(list(sets), linked)
    assert sum(i != c for i, c in got.items()) >= 30


@pytest.mark.parametrize("limit", [64, 1])
def test_near_copies_are_all_pairs_of_the_similarity(docs_of, monkeypatch, limit):
    monkeypatch.setattr(near_copies, "BUCKET_PAIRS", limit)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.randint(100, 400))]
        copy = list(text)
        for _ in range(max(1, len(text) * (1 + i % 3) // 120)):
            copy[rng.randrange(len(text))] = rng.choice(words)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    sets = {i: near_copies.shingle_set(t) for i, t in rows}
    marks = {i: simhash.fingerprint(t, 2) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and near_copies._similar(sets[a], sets[b], 0.8)]
    assert sum((marks[a] ^ marks[b]).bit_count() > 6 for a, b in linked) >= 3
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs_of(rows)).collect()}
    assert got == closure(list(sets), linked)


def test_one_id_with_several_texts(spark, docs_of):
    """Every text of an id has its near copies, and rows are judged by their own text."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    rows, copies = [], []
    for i in range(12):
        for _ in range(2):
            text = [rng.choice(words) for _ in range(150)]
            rows.append((10 + i, " ".join(text)))
            text[70] = "changed"
            copies.append((100 + len(copies), " ".join(text)))
    rows += [rows[0]] * 40
    got = [(r.doc_id, r.component_id) for r in near_copies.near_copies(docs_of(rows + copies)).collect()]
    assert len(got) == len(rows) + len(copies)
    of = dict(got)
    assert [of[100 + k] for k in range(24)] == [10 + k // 2 for k in range(24)]
    late = [(7, copies[0][1]), (50, rows[0][1]), (50, "another text of its own that stays " * 9)]
    left = near_copies.stage(spark, docs_of(late), "").collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([late[0], late[2]])


def test_cells_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(4)
    ruled_out = 0
    for _ in range(3000):
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64) * np.uint64(2))
        other = np.unique(np.concatenate((base[rng.random(len(base)) < rng.uniform(0.6, 1)], rng.integers(0, 1 << 63, int(rng.integers(0, 40)), dtype=np.uint64))))
        far = near_copies._far_apart(near_copies._cells(base), near_copies._cells(other), np.int64(len(base) + len(other)), 0.8)
        ruled_out += bool(far)
        assert not (far and near_copies._similar(base, other, 0.8))
    assert ruled_out > 300


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (None, 3)]
    rows = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.component for r in rows}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000)} and len(rows) == len(got)


def test_simhash_is_the_first_round_of_near_copies(spark, docs_of, monkeypatch):
    """Copies with a word changed meet by their fingerprints; what those join is verified in that round."""
    words = [f"w{i}" for i in range(900)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["other"])), (3, " ".join(f"v{i}" for i in range(900)))]
    found, alike = [], near_copies._alike

    def spied(nodes):
        found.append(alike(nodes))
        pairs = {(r.a, r.b) for r in found[-1].collect()}
        marks = {r.node: r.fp for r in nodes.collect()}
        near = {(a, b) for a in marks for b in marks if a < b and ((marks[a] ^ marks[b]) & (1 << 64) - 1).bit_count() <= 2}
        assert pairs == near and len(near) == 1
        return found[-1]

    monkeypatch.setattr(near_copies, "_alike", spied)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs_of(rows)).collect()}
    assert found and got == {1: 1, 2: 1, 3: 3}


def test_parities_never_rule_out_a_similar_pair(monkeypatch):
    rng = np.random.default_rng(9)
    ruled_out = 0
    for bits in (16, 7):
        monkeypatch.setattr(near_copies, "PARITY_BITS", bits)
        for _ in range(1500):
            base = np.unique(rng.integers(0, 1 << 64, int(rng.integers(0, 900)), dtype=np.uint64))
            other = np.unique(np.concatenate((base[rng.random(len(base)) < rng.uniform(0.6, 1)], rng.integers(0, 1 << 64, int(rng.integers(0, 60)), dtype=np.uint64))))
            least = near_copies._differing(near_copies._parities(base), near_copies._parities(other))
            assert least <= len(np.setxor1d(base, other))
            far = least * 1.8 > 0.2 * (len(base) + len(other)) + 1e-6
            ruled_out += far
            assert not (far and len(base) + len(other) and near_copies._similar(base, other, 0.8))
    assert ruled_out > 300


def test_sets_are_fetched_for_pairs_that_are_similar(docs_of, monkeypatch):
    """Long texts that share half of their passages meet in buckets; their sets are not fetched for it."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    shared = [rng.choice(words) for _ in range(900)]
    rows = [(i, " ".join(shared + [rng.choice(words) for _ in range(900)])) for i in range(8)]
    rows += [(100 + i, t.replace(" ", " more ", 9)) for i, t in rows[:2]]
    asked, verified = [], near_copies._verified

    def spied(pairs, sets, similarity):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return verified(pairs, sets, similarity)

    monkeypatch.setattr(near_copies, "_verified", spied)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs_of(rows)).collect()}
    assert got == {**{i: i for i in range(8)}, 100: 0, 101: 1}
    assert len(set(asked)) == 2


def test_order_counts_a_fixed_share_of_the_texts(docs_of, monkeypatch):
    """In a table far beyond ``ORDER_TEXTS`` passages that many texts share still come last and make no crowds."""
    monkeypatch.setattr(near_copies, "ORDER_TEXTS", 8)
    monkeypatch.setattr(near_copies, "BUCKET_PAIRS", 8)
    rng = random.Random(13)
    words = [f"w{i}" for i in range(5000)]
    passages = [[rng.choice(words) for _ in range(60)] for _ in range(10)]
    rows = [(i, " ".join(passages[i % 10] + [rng.choice(words) for _ in range(60)])) for i in range(1200)]
    rows += [(2000 + i, t + " end") for i, t in rows[:20]]
    joined, crowds = [], near_copies._crowds

    def spied(met):
        found = crowds(met)
        joined.append(found.count())
        return found

    monkeypatch.setattr(near_copies, "_crowds", spied)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs_of(rows)).select("doc_id", "component_id").collect() if r.doc_id != r.component_id}
    assert got == {2000 + i: i for i in range(20)}
    assert joined == [0]


def test_most_frequent_takes_a_share_of_equal_counts(spark):
    rows = spark.createDataFrame([(i, 9 if i < 50 else 5 if i < 5000 else 3) for i in range(9000)], "shingle long, n long").repartition(3)
    found = {r.shingle: r.n for r in near_copies._most_frequent(rows, 1000).collect()}
    assert set(range(50)) < set(found) and 800 < len(found) < 1100 and 3 not in found.values()
    assert near_copies._most_frequent(rows, 9000).count() == 9000


def test_large_crowds_meet_by_size(spark, monkeypatch):
    """Only blocks whose sizes may be similar meet, and every pair of similar sizes does."""
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rng = random.Random(14)
    size = {i: rng.choice([1, 2, 4, 5, 100, 125, rng.randint(1, 3000)]) for i in range(200)} | {300: 7, 301: 900}
    crowds = spark.createDataFrame([(i, int(i >= 300)) for i in size], "node long, crowd long")
    sizes = spark.createDataFrame(list(size.items()), "node long, size long")
    groups = {}
    for r in near_copies._meetings(crowds, sizes, 0.8).collect():
        groups.setdefault((r.crowd, r.low, r.high), set()).add(r.node)
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert all((a, b) in met for a in range(200) for b in range(a + 1, 200) if min(size[a], size[b]) >= 0.8 * max(size[a], size[b]))
    assert sum(len(g) for g in groups.values()) < 200 * 13 / 2
    assert [g for (crowd, _, _), g in groups.items() if crowd] == [{300, 301}]


def test_rows_without_an_id_are_compared(spark, docs_of):
    """Near copies of them and over them are found; they name no component and stay."""
    rng = random.Random(15)
    words = [f"w{i}" for i in range(2000)]

    def changed(text, at):
        return " ".join(w if not at <= i < at + 4 else f"new{i}" for i, w in enumerate(text.split()))

    first, second, third = (" ".join(rng.choice(words) for _ in range(120)) for _ in range(3))
    rows = [(5, first), (None, changed(first, 10)), (7, changed(changed(first, 10), 60)), (None, second), (9, changed(second, 30)),
            (None, third), (None, changed(third, 30)), (None, third), (None, "alone here"), (11, "alone there")]
    sets = [near_copies.shingle_set(t) for _, t in rows]
    similar = {(a, b) for a in range(len(rows)) for b in range(a) if near_copies._similar(sets[a], sets[b], 0.8)}
    assert similar == {(1, 0), (2, 1), (4, 3), (6, 5), (7, 5), (7, 6)}
    got = sorted(((r.doc_id, r.component_id) for r in near_copies.near_copies(docs_of(rows)).collect()), key=str)
    assert got == sorted([(5, 5), (None, 5), (7, 5), (None, 9), (9, 9), (None, None), (None, None), (None, None), (None, None), (11, 11)], key=str)
    left = near_copies.stage(spark, docs_of(rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted((row for row in rows if row[0] != 7), key=str)


@pytest.mark.parametrize("bits", [1 << 25, 256])
def test_few_texts_but_those_asked_for_are_dealt_out(docs_of, monkeypatch, bits):
    monkeypatch.setattr(near_copies, "FILTER_BITS", bits)
    rows = [(i if i % 3 else None, f"text {i}") for i in range(3000)] + [(1, "text 1"), (7, None)]
    plain = docs_of(rows).selectExpr("doc_id AS i", "text AS t", "xxhash64(text) AS h")
    asked = plain.where("t IN ('text 1', 'text 2', 'text 2997') OR t IS NULL").selectExpr("h AS hash")
    found = sorted(((r.i, r.t) for r in near_copies._wanted(plain, asked).collect()), key=str)
    assert {(1, "text 1"), (2, "text 2"), (None, "text 2997"), (7, None)} <= set(found) and found.count((1, "text 1")) == 2
    assert len(found) < (10 if bits > 256 else 150)
