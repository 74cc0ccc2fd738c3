"""Search and list queries over a small archive."""

import re
import unicodedata

import pytest
from helpers import message, node, record, records_frame, tree

from colloquy.functions import fold
from colloquy.operators import browse, project, search
from colloquy.operators.browse import ConversationQuery as Q
from colloquy.plans.archive import Archive

FILES = "name string, byte_size bigint, detected_mime string, detected_extension string, preview_kind string, width bigint, height bigint"
TEXTS = (
    "alpha beta gamma", "Alphabet soup, beta-test", "foo-bar baz", "foo baz bar", "Élan vital OR bust", "beta alpha",
    "naïve café", "x1 y2 z3", "",
)


def convo(i, text, **header):
    mapping = tree({"a": None, "b": "a"})
    mapping["b"]["message"] = message(text, role="assistant", mid="mb")
    mapping["a"]["message"] = None
    return record(mapping, "b", id=f"c{i}", title=f"T{i}", **header)


@pytest.fixture(scope="module")
def archive(spark):
    records = [convo(i, t, create_time=float(i), is_archived=[None, True, False][i % 3]) for i, t in enumerate(TEXTS)]
    records += [convo(100 + i, f"group{'three' if i < 3 else 'fifty'} word", update_time=1000.0 + i // 2) for i in range(54)]
    records.append(convo(200, "effective", create_time=950.0, update_time=200.0))
    records.append(convo(201, "effective", create_time=10.0, update_time=900.0))
    records.append(
        record(
            {"a": node("a", None, [], message("with file", metadata={"attachments": [
                {"id": "file-1", "name": "s.wav"}, {"id": "file-gone", "name": "g"}]}))},
            "a", id="c300",
        )
    )
    table = project.project_records(records_frame(spark, records)).cache()
    files = spark.createDataFrame([("file-1.dat", 9, "audio/x-wav", "wav", "audio", None, None)], FILES)
    return Archive(table, files)


def fold_py(text):
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", bare)


def matches_py(text, title, asked):
    columns = [fold_py(title), fold_py(text)]
    terms = asked.split()

    def hit(words):
        return bool(words) and any(
            column[p : p + len(words) - 1] == words[:-1] and len(column) >= p + len(words)
            and column[p + len(words) - 1].startswith(words[-1])
            for column in columns for p in range(len(column))
        )

    return bool(terms) and all(hit(fold_py(t)) for t in terms)


ASKED = ("alpha", "alpha beta", "beta-t", "foo-bar", "bar foo", "elan", "ÉLAN or", '"OR"', "cafe naive", "t1", "...", "zzz", "y2 x", "... alpha",
         " ".join(["alpha"] * 20), " ".join(["alpha"] * 20) + " zzzz")


def test_matches_equal_brute_force(spark, archive):
    terms = search.search_terms(spark.createDataFrame(list(enumerate(ASKED)), "query_id int, search string"))
    titles = archive.conversations.select("conversation_key", "title")
    got = {(r.query_id, r.title) for r in search.matches(terms, archive.postings).join(titles, "conversation_key").collect()}
    want = {
        (q, f"T{i}") for q, asked in enumerate(ASKED) for i, t in enumerate(TEXTS) if matches_py(t, f"T{i}", asked)
    }
    assert {x for x in got if int(x[1][1:]) < len(TEXTS)} == want


def test_every_term_counts(spark, archive):
    words = " ".join(f"w{i}" for i in range(40)) + " " + "x" * 600
    asked = spark.createDataFrame([(0, words)], "query_id int, search string")
    assert search.search_terms(asked).count() == 41
    many = [["alpha"]] * 20
    assert search.one_search(archive.postings, many).count() == search.one_search(archive.postings, many[:1]).count() > 0
    assert search.one_search(archive.postings, [*many, ["zzzz"]]).count() == 0


def test_fold(value):
    assert value(fold.tokens, ["Crème-BRÛLÉE Ñandú 12 ß", "éa"]) == [["creme", "brulee", "nandu", "12", "ß"], ["ea"]]


@pytest.mark.parametrize("word, total", [("groupthree", 3), ("groupfifty", 51), ("group", 54)])
def test_pages_have_no_gaps(archive, word, total):
    seen, page = [], 0
    while True:
        rows, totals = archive.list_conversations(Q(search=word, page=page))
        seen += [r.conversation_key for r in rows.collect()]
        summary = totals.first()
        assert summary.total == total
        page += 1
        if not summary.has_more:
            break
    assert len(seen) == len(set(seen)) == total and page == -(-total // 50)


def test_page_order_and_preview(archive):
    rows = archive.list_conversations(Q(search="group wor", page_size=3))[0].collect()
    assert [r.updated_at for r in rows] == [1026.0, 1026.0, 1025.0]
    assert rows[0].conversation_key < rows[1].conversation_key
    assert rows[0].match_preview == "groupfifty word"


def test_effective_time(archive):
    rows = archive.list_conversations(Q(search="effective", date_from=500.0))[0].collect()
    assert [r.updated_at for r in rows] == [900.0]


def test_kind_and_role_filters(archive):
    counts = {k: archive.list_conversations(Q(attachment_kind=k))[1].first().total for k in ("audio", "other", "missing")}
    assert counts == {"audio": 1, "other": 0, "missing": 1}
    everything = archive.conversations.count()
    assert archive.list_conversations(Q(role="other"))[1].first().total == everything - 1
    assert archive.list_conversations(Q(role="robot", date_to=float("inf")))[1].first().total == everything


def test_archived_filter(archive):
    some = [i % 3 for i in range(len(TEXTS))]
    assert browse.filtered(Q(archived=True), archive.conversations).count() == some.count(1)
    assert browse.filtered(Q(archived=False), archive.conversations).count() == archive.conversations.count() - some.count(1)


def test_pages_are_not_clamped():
    assert Q(page=10**6, page_size=0).offset_and_limit == (10**6, 1)
    assert Q(page_size=500).offset_and_limit == (0, 500)


def test_snippet_window(spark):
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(60)]
    rows = spark.createDataFrame(
        [(" ".join(words), [(5, 0), (30, 0), (41, 1)]), (" ".join(words), [(55, 0)]), ("one, two.", []), (" ".join(words), [])],
        "body string, starts array<struct<start: int, term_no: int>>",
    ).repartition(1)
    got = [r[0] for r in rows.select(search.snippet(F.col("body"), F.col("starts"))).collect()]
    assert got == [
        "… " + " ".join(words[30:48]) + " …", "… " + " ".join(words[42:]), "one, two", " ".join(words[:18]) + " …",
    ]


def test_prefix_reaches_the_index_scan(archive):
    plan = search.phrase_filter(archive.postings, ["alp"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,alp)" in plan


def test_postings_and_single_words_are_made_in_place(spark, archive):
    """Neither the postings nor the starts of one-word terms pass a shuffle of single positions."""
    built = search.postings(archive.search_documents)
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()
    got = {(r.conversation_key, r.column, r.token): list(r.positions) for r in built.collect()}
    want = {}
    for r in archive.search_documents.collect():
        for column in ("title", "body"):
            for at, word in enumerate(fold_py(r[column])):
                want.setdefault((r.conversation_key, column, word), []).append(at)
    assert got == want
    asked = search.search_terms(spark.createDataFrame([(1, "be foo-b"), (2, "alpha")], "query_id int, search string"))
    hits = search.term_hits(search.term_words(asked), archive.postings)
    grouped = hits._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "explode(starts" in grouped and "aggregate [query_id, term_no, conversation_key, column, start" not in grouped
    texts = {r.conversation_key: {"title": fold_py(r.title), "body": fold_py(r.body)} for r in archive.search_documents.collect()}
    expected = {
        (q, no, key, column, at) for q, no, term in ((1, 0, ["be"]), (1, 1, ["foo", "b"]), (2, 0, ["alpha"]))
        for key, columns in texts.items() for column, words in columns.items() for at in range(len(words))
        if words[at:at + len(term) - 1] == term[:-1] and len(words) >= at + len(term) and words[at + len(term) - 1].startswith(term[-1])
    }
    rows = [tuple(r) for r in hits.select("query_id", "term_no", "conversation_key", "column", "start").collect()]
    assert set(rows) == expected and len(rows) == len(expected) > 3
