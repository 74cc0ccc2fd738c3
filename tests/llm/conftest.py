import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang)`` rows, spread over some partitions."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def sf_dir(spark, docs_of, tmp_path_factory):
    """A folder with a small documents and a labels table."""
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 120)))
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "%%%" for w in text.split()) if bad else text))
        labels.append((i, int(not bad), 0))
    rows += [(400, rows[1][1]), (401, rows[2][1] + " extra"), (402, None), (403, "")]
    folder = tmp_path_factory.mktemp("sf")
    docs_of(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)
