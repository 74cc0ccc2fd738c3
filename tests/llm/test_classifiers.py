import math
import zlib

import numpy as np
import pytest

from colloquy.llm import language, lm_score, quality
from colloquy.llm.common import table


def test_quality_on_held_out_rows(spark, sf_dir):
    rows = {r.doc_id: r for r in quality.op5_quality(spark, sf_dir).collect()}
    truth = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    assert len(rows) == 404
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.5)
    held = [i for i in truth if rows[i].held_out]
    assert sum(rows[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert rows[402].score == rows[403].score


def test_quality_votes_by_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    voters = quality.fit(docs, table(spark, sf_dir, "labels"), per_class=40)
    assert len(voters.labels) == 80
    text = docs.where("doc_id = 9").first().text
    counts = quality.features(text)[None]
    near = (voters.project(counts) @ voters.vectors.T)[0]
    best = sorted(range(80), key=lambda i: -near[i])[: quality.NEIGHBOURS]
    weight = [math.exp(quality.SHARPNESS * float(near[i])) for i in best]
    want = sum(w * voters.labels[i] for w, i in zip(weight, best)) / sum(weight)
    assert voters.scores(counts)[0] == pytest.approx(want, abs=1e-5)


def test_quality_features():
    found = quality.features("the the cat\nsat.\nsat.")
    assert found[: quality.FEATURES].sum() == len("the the cat\nsat.\nsat.") - 2
    assert found[quality.FEATURES:].tolist() == [1000 * 2 // 5, 1000 // 3, 0, 1000 * 2 // 21]
    assert not quality.features(None).any() and quality.features("x" * 3_000_000)[: quality.FEATURES].sum() == 2_999_998


def test_quality_without_labels_or_rows(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0
    extra = docs.selectExpr("*", "1 AS score", "2 AS quality", "3 AS feature")
    assert quality.stage(spark, extra, sf_dir).columns == extra.columns


SENTENCES = {
    "en": ["the quick brown fox jumps over the lazy dog", "this is the house that they have built with their own hands"],
    "de": ["der schnelle braune fuchs springt über den faulen hund", "dies ist das haus das sie mit eigenen händen gebaut haben"],
    "fr": ["le renard brun rapide saute par dessus le chien paresseux", "voici la maison qu'ils ont construite de leurs propres mains"],
}


def test_language(docs_of):
    rows = [(10 * i + j, (SENTENCES[x][j % 2] + " ") * (1 + j % 4), x) for i, x in enumerate(SENTENCES) for j in range(10)]
    languages = language.fit(docs_of(rows + [(90, "nobody knows", None), (91, None, "en")]))
    assert languages.names == sorted(SENTENCES)
    mixed = SENTENCES["en"][0] * 3 + " " + SENTENCES["fr"][0]
    asked = docs_of([(1, SENTENCES["de"][1]), (2, None), (3, ""), (4, "12 %% 34"), (5, mixed), (6, SENTENCES["fr"][1] * 40_000), (1, SENTENCES["de"][1])]).selectExpr("*", "1 AS lang_pred", "2 AS t")
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(asked, languages).collect())
    assert [g[:2] for g in got] == [(1, "de"), (1, "de"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (6, "fr")]
    assert all(0 <= g[2] <= 1 for g in got) and got[5][2] < got[0][2]
    assert language.identify(asked, language.fit(docs_of(rows).limit(0))).first().lang_pred == "und"
    assert language.identify(asked.limit(0), languages).count() == 0


def test_language_trigrams_and_mixture():
    buckets, counts = language.trigrams("Ab, ab1ab")
    assert counts.sum() == len(" ab ab ab ") - 2 and language.trigrams("!!")[1].sum() == 0
    languages = language.Languages(["x", "y"], np.random.default_rng(0).integers(0, 50, (2, language.BUCKETS)).astype(float))
    chance, n = languages.chance[:, [3, 9, 27]], np.array([5, 2, 1])
    share, value = languages.mixture(chance, n)
    grid = max((float(n @ np.log(p * chance[0] + (1 - p) * chance[1])), p) for p in np.linspace(0, 1, 2001))
    assert share.sum() == pytest.approx(1) and value <= grid[0] + 1e-9 and value > grid[0] - 0.2


def test_language_query_learns_from_three_folds(spark, sf_dir):
    rows = language.op4_language(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (402, 403)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id < 400} == {"en"}


def test_lm_by_brute_force(spark):
    good = ["a b c a b", "a b d"]
    other = ["x y x y x", "b a", "", None]
    marked = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in other], "text string, is_target boolean")
    models = lm_score.fit(marked)

    def counts(texts):
        words, pairs = {}, {}
        for t in texts:
            ids = [int(x) for x in lm_score.tokens(t)]
            for h, w in zip([0, *ids], ids):
                words[w] = words.get(w, 0) + 1
                p = int(lm_score.pair_buckets(np.array([h]), np.array([w]))[0])
                pairs[p] = pairs.get(p, 0) + 1
        return words, pairs

    def loss(text, texts, scale):
        words, pairs = counts(texts)
        total, out = scale * sum(words.values()), []
        ids = [int(x) for x in lm_score.tokens(text)]
        for h, w in zip([0, *ids], ids):
            chance = (scale * words.get(w, 0) + 1 / lm_score.WORDS) / (total + 1)
            seen = scale * pairs.get(int(lm_score.pair_buckets(np.array([h]), np.array([w]))[0]), 0)
            whole = scale * words.get(h, 0) if h else seen
            out.append(-math.log((min(seen, whole) + lm_score.PRIOR * chance) / (whole + lm_score.PRIOR)))
        return sum(out) / len(out)

    scale = 8 / 15
    docs = spark.createDataFrame([(1, "a b c"), (2, "x y z"), (3, None), (4, " "), (1, "a b c")], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS t")
    rows = lm_score.score(docs, models).collect()
    assert len(rows) == 5
    for r in rows:
        text = {1: "a b c", 2: "x y z"}.get(r.doc_id)
        if text is None:
            assert (r.n_tokens, r.target_loss, r.background_loss, r.score) == (0, 0, 0, 0)
        else:
            assert r.target_loss == pytest.approx(loss(text, good, 1), rel=1e-4)
            assert r.background_loss == pytest.approx(loss(text, good + other, scale), rel=1e-4)
            assert r.score == pytest.approx(r.target_loss - r.background_loss, abs=1e-6)
    assert lm_score.score(docs.limit(0), lm_score.fit(marked.limit(0))).count() == 0


def test_lm_query_ranks_good_below_bad(spark, sf_dir):
    rows = {r.doc_id: r.score for r in lm_score.op10_cross_entropy_difference(spark, sf_dir).collect()}
    good, bad = [rows[i] for i in range(400) if i % 4], [rows[i] for i in range(0, 400, 4)]
    assert len(rows) == 404 and max(good) < min(bad)


def test_lm_counts_are_exact_over_many_words(spark, monkeypatch):
    """More different words and pairs than a table of fixed size could tell apart."""
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", 1 << 18)
    monkeypatch.setattr(lm_score, "RANGE_TOKENS", 1 << 16)
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(10_000)) + " common words") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = lm_score.fit(docs.selectExpr("text", "doc_id % 3 = 0 AS is_target"))
    total, share = 10_002 * 10, 1 / lm_score.WORDS
    for r in lm_score.score(docs, models).collect():
        want = []
        for scale, rare, shared in ((1, int(r.doc_id % 3 == 0), 10), (1 / 3, 1 / 3, 10)):
            chance = [(c + share) / (total + 1) for c in (rare, shared)]
            loss = [-math.log((s + lm_score.PRIOR * p) / (w + lm_score.PRIOR)) for s, w, p in (
                (rare, rare, chance[0]), (rare, rare, chance[1]), (shared, shared, chance[1]))]
            want.append((10_000 * loss[0] + loss[1] + loss[2]) / 10_002)
        assert (r.target_loss, r.background_loss) == pytest.approx(want, rel=1e-9)
