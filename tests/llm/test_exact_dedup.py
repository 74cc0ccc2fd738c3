import duckdb
import pytest

from colloquy.llm import exact_dedup

ROWS = [
    (1, "a b\tc"), (2, "abc"), (3, "a  b c"), (4, None), (5, ""), (6, " \n\x0b\x0c\r"), (7, "A b c"), (8, "é x"),
    (9, "é  x"), (10, "x" * 50_000), (11, "x" * 50_000), (None, "abc"), (12, "a\x00b"), (13, "ab"),
]


def by_sql(rows):
    import pandas as pd

    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]})  # noqa: F841
    return sorted(map(str, duckdb.sql(exact_dedup.ORACLE).fetchall()))


def found(docs, **kw):
    out = exact_dedup.exact_duplicates(docs, **kw).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted(str(tuple(r)) for r in out.collect())


def test_matches_sql(docs_of):
    assert found(docs_of(ROWS)) == by_sql(ROWS)


def test_hot_text_in_chunks(docs_of, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 20)
    rows = [(i, " same" * (i % 3) if i % 3 else f"text {i}") for i in range(300)]
    assert found(docs_of(rows)) == by_sql(rows)


def test_repeated_rows_keep_one(docs_of):
    rows = exact_dedup.exact_duplicates(docs_of([(1, "t"), (1, "t"), (1, "t")])).collect()
    assert [r.group_size for r in rows] == [3] * 3 and sum(r.kept for r in rows) == 1


def test_empty_and_clashing_columns(spark, docs_of):
    assert found(docs_of(ROWS).limit(0)) == []
    extra = docs_of(ROWS).selectExpr("*", "1 AS h", "2 AS chunk", "3 AS kept", "'n' AS norm", "4 AS `row`", "5 AS prefix")
    assert found(extra) == by_sql(ROWS)
    kept = exact_dedup.stage(spark, extra, "")
    assert kept.columns == extra.columns and kept.count() == len({(t or "").translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))) for _, t in ROWS})


@pytest.mark.parametrize("word", ["Python", "Pandas", "Arrow"])
def test_plan_is_native(docs_of, word):
    plan = exact_dedup.exact_duplicates(docs_of(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert word not in plan
