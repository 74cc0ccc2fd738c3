import corpus_pipeline
from colloquy.llm import bpe, near_copies, packing, quality
from colloquy.llm.common import stored, table


def test_stages_by_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(packing, "SIZE", 1024)
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    voters = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    left = {i: t for i, t in rows.items() if voters.scores(quality.features(t)[None])[0] >= 0.5}
    by_text = {}
    for i, t in sorted(left.items()):
        by_text.setdefault("".join((t or "").split()), []).append(i)
    left = {(best := max(ids, key=lambda i: (len(left[i] or ""), -i))): left[best] for ids in by_text.values()}
    kept = {}
    for i, t in sorted(left.items()):
        own = near_copies.shingle_set(t)
        if not any(near_copies._similar(own, other, 0.8) for other, _ in kept.values()):
            kept[i] = (own, t)
    seen, after = set(), {}
    for i, (_, t) in sorted(kept.items()):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        windows = [raw[k:k + 50] for k in range(len(raw) - 49)]
        for k, w in enumerate(windows):
            if w in seen:
                gone[k:k + 50] = b"\1" * 50
        seen |= set(windows)
        after[i] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
    assert {r.doc_id: r.text or "" for r in docs.collect()} == after
    assert 400 not in after and 401 not in after and 8 not in after
    out = corpus_pipeline.run(spark, sf_dir).collect()
    lengths = {}
    for r in out:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(bpe.codec().encode(t)) + 1 for i, t in after.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash_dedup", "repeated_windows", "packing"]


def test_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0
