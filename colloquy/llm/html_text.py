"""Main text of web pages.

Every page is compared with the nearest different page by URL path on its host: the text
lines of both are aligned by their longest common subsequence, and the shared lines, the
template, are deleted.  The markup has votes of its own: it says what isn't part of a
declared article, and lines that it makes paragraphs, headings, items, cells or quotes of
that article stay, since copies and licence lines belong to their article.  Pages that
declare an article are compared with each other, and so are those that don't.

Neighbours come from a range-partitioned sort by host and path, so that a host with
many pages is spread over tasks.  Each range reports its first and last pages in one
small row; from these rows follows which page beyond its edges a range needs, so the
result doesn't depend on the ranges.  Pages are dealt and compared by digests of their
lines; their text isn't shuffled but where lines are deleted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import stored, table

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead "
    "title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset(
    "head title script style noscript template iframe object svg canvas nav header footer aside form button select "
    "textarea dialog menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies respond discussion disqus "
    "notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "social share sharing related recommended widget toolbar pagination".split()
)
ARTICLE_HINTS = frozenset("comment comments reply replies ad ads advert advertisement promo sponsored related".split())
# Words that a container's name may have beside hints; with any other word ("related-work", "has-header") it is content.
NEUTRAL = frozenset("area bar block box container inner item items link links list section slot unit wrap wrapper".split())
# Elements whose class and id count; a hint on a paragraph, a list item or inline text doesn't take text away.
CONTAINERS = frozenset("article aside details div dl figure ol section table ul".split())
_WORDS = re.compile(r"[a-z]+")
# Elements whose lines in a declared article are its text, shared or not.
PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
PLACED = ["part", "place", "row", "host", "lines", "prose", "edge"]
EDGE = pa.struct([("first_host", pa.string()), ("first", pa.string()), ("second", pa.int64()),
                  ("last_host", pa.string()), ("last", pa.string()), ("prior", pa.int64())])


def _hinted(names: str, hints: frozenset[str]) -> bool:
    """Whether one of the class and id names consists of hints, neutral words aside."""
    for name in names.split():
        words = set(_WORDS.findall(name))
        if words & hints and words <= hints | NEUTRAL:
            return True
    return False


class _Page(HTMLParser):
    """Text blocks of a page; those of articles and of the main element apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.dropped = self.articles = self.mains = 0
        self.seen_article = self.seen_main = False
        self.held: list[str] = []
        self.body: list[tuple[str, bool]] = []
        self.main: list[tuple[str, bool]] = []
        self.article: list[tuple[str, bool]] = []
        self.main_article: list[tuple[str, bool]] = []

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            self.held = []
            if text:
                line = text, self._prose()
                self.body.append(line)
                if self.mains:
                    self.main.append(line)
                if self.articles:
                    self.article.append(line)
                    if self.mains:
                        self.main_article.append(line)

    def _prose(self) -> bool:
        for tag, _ in reversed(self.open):
            if tag in ("article", "main"):
                return False
            if tag in PROSE:
                return True
        return False

    def _foreign(self, tag: str, attrs: list) -> bool:
        if tag in NOT_TEXT:
            return True
        said = {name: (value or "").lower() for name, value in attrs}
        if "hidden" in said or said.get("role") in ROLES:
            return True
        if tag not in CONTAINERS:
            return False
        return _hinted(said.get("class", "") + " " + said.get("id", ""), ARTICLE_HINTS if tag == "article" else HINTS)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag in ("td", "th"):
            self.held.append(" ")
        if tag in VOID:
            return
        if tag == "p" and any(name == "p" for name, _ in self.open[-4:]):
            self._close("p")
        elif tag == "li" and self.open and self.open[-1][0] == "li":
            self._close("li")
        foreign = self._foreign(tag, attrs)
        self.open.append((tag, foreign))
        self.dropped += foreign
        if not self.dropped:
            if tag == "article":
                self.articles += 1
                self.seen_article = True
            elif tag == "main":
                self.mains += 1
                self.seen_main = True

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            # Browsers ignore the slash of an element that isn't void.
            self.handle_starttag(tag, attrs)

    def _close(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                break
        else:
            return
        while len(self.open) > at:
            name, foreign = self.open.pop()
            if not self.dropped:
                if name == "article":
                    self.articles -= 1
                elif name == "main":
                    self.mains -= 1
            self.dropped -= foreign

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.held.append(data)


def page_blocks(html: str | None) -> tuple[list[str], bool, list[bool]]:
    """Text blocks in page order, whether the page declares them to be its article, and which of them are that article's prose."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    if page.seen_main:
        # Articles outside the main element are teasers, unless the main element is empty.
        found = page.main_article or page.main
        found = found if found or not page.article else page.article
    else:
        found = page.article if page.seen_article else page.body
    declared = page.seen_main or page.seen_article
    return [line for line, _ in found], declared, [declared and prose for _, prose in found]


def common_lines(mine: list[str], other: list[str]) -> list[bool]:
    """Which of my lines are in a longest common subsequence of both pages (bit-parallel rows, walked back)."""
    shared = [False] * len(mine)
    known = set(other)
    rows = [i for i, line in enumerate(mine) if line in known]
    known = set(mine)
    columns = [line for line in other if line in known]
    places: dict[str, int] = {}
    for j, line in enumerate(columns):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(columns)) - 1
    states, state = [full], full
    for i in rows:
        match = state & places[mine[i]]
        state = ((state + match) | (state - match)) & full
        states.append(state)
    j = len(columns)
    for at in range(len(rows), 0, -1):
        # A zero bit below j is a line gained; the walk keeps to the row where it first appears.
        now, before = states[at], states[at - 1]
        below = (1 << j) - 1
        if (now & below).bit_count() == (before & below).bit_count():
            continue
        shared[rows[at - 1]] = True
        gained = j - (before & below).bit_count()
        # The longest prefix of the other page's lines that still has what the rows above gained.
        hits = places[mine[rows[at - 1]]] & below
        while hits:
            top = hits.bit_length() - 1
            if top - (before & ((1 << top) - 1)).bit_count() == gained:
                j = top
                break
            hits ^= 1 << top
    return shared


DIGEST = 16


def template_lines(mine: bytes, other: bytes | None, prose: str) -> list[int]:
    """The numbers of my lines that the nearest different page shares, however many they are; prose of an article aside.

    Pages are the digests of their lines; ``prose`` has a ``1`` for each line that stays.
    """
    if not mine or not other or "0" not in prose:
        return []
    shared = common_lines(*([page[i:i + DIGEST] for i in range(0, len(page), DIGEST)] for page in (mine, other)))
    return [i for i, (same, stays) in enumerate(zip(shared, prose)) if same and stays == "0"]


def _digests(blocks: list[str]) -> bytes:
    return b"".join(hashlib.md5(line.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for line in blocks)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [page_blocks(html.as_py()) for html in batch.column(2)]
        texts = ["\n".join(blocks) for blocks, _, _ in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()),
             pa.array(list(map(len, texts)), pa.int64()), pa.array([declared for _, declared, _ in found], pa.bool_()),
             pa.array([_digests(blocks) for blocks, _, _ in found], pa.binary()),
             pa.array(["".join("01"[p] for p in prose) for _, _, prose in found], pa.string())],
            names=["page_id", "url", "text", "n_chars", "declared", "lines", "prose"],
        )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted rows of a range; the last row tells of its edges instead of a page.

    An edge names the first and the last host with the digest of their outermost pages,
    and the places of the pages next to those that differ from them (-1: none there).
    """
    part, place = TaskContext.get().partitionId(), 0
    first = last = None
    second, prior = -1, -1
    for batch in batches:
        digests = [hashlib.md5(lines.as_py(), usedforsecurity=False).hexdigest() for lines in batch.column("lines")]
        for at, now in enumerate(zip(batch.column("host").to_pylist(), digests)):
            if first is None:
                first = now
            elif second < 0 and now[0] == first[0] and now[1] != first[1]:
                second = place + at
            if last is not None and now != last:
                prior = place + at - 1 if now[0] == last[0] else -1
            last = now
        places = pa.array(np.arange(place, place + batch.num_rows))
        none = pa.nulls(batch.num_rows, EDGE)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part)), places, *batch.columns, none], names=PLACED)
        place += batch.num_rows
    if place:
        edge = {"first_host": first[0], "first": first[1], "second": second, "last_host": last[0], "last": last[1], "prior": prior}
        nothing = [pa.nulls(1, kind) for kind in (pa.int64(), pa.string(), pa.binary(), pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([place - 1]), *nothing, pa.array([edge], EDGE)], names=PLACED)


def beyond(edges: list) -> list[tuple[int, bool, int, int]]:
    """``(part, later, its part, its place)`` of the nearest different pages of the same host outside each range.

    ``edges`` has one row of ``_placed`` a range, in order.
    """
    found = []
    for later in (False, True):
        host = near = other = None
        for row in reversed(edges) if later else edges:
            e = row.edge
            # The side that faces the ranges already seen, and the far side.
            face, mark, out_host, out_mark, out_place, differs = (
                (e.last_host, e.last, e.first_host, e.first, 0, e.second) if later
                else (e.first_host, e.first, e.last_host, e.last, row.place, e.prior))
            if host == face:
                place = near[1] if near[0] != mark else other
                if place is not None:
                    found.append((row.part, later, *place))
            seen = (row.part, differs) if differs >= 0 else None
            if seen is None and host == face == out_host:
                seen = near[1] if near[0] != out_mark else other
            host, near, other = out_host, (out_mark, (row.part, out_place)), seen
    return found


def _differenced(rows: pa.Table, edges: pa.Table) -> pa.Table:
    """What the pages of a range lose: each meets the last different one before it on its host, else the next one."""
    rows = rows.sort_by("place")
    outside = dict(zip(edges.column("later").to_pylist(), edges.column("lines").to_pylist()))
    hosts, texts = rows.column("host").to_pylist(), rows.column("lines").to_pylist()
    names, prose = rows.column("row").to_pylist(), rows.column("prose").to_pylist()
    starts = [i for i in range(len(texts)) if not i or (hosts[i], texts[i]) != (hosts[i - 1], texts[i - 1])]
    ends = [*starts[1:], len(texts)][:len(starts)]
    out: list[tuple[int, list[int]]] = []
    for start, end in zip(starts, ends):
        if start:
            before = texts[start - 1] if hosts[start - 1] == hosts[start] else None
        else:
            before = outside.get(False)
        if end < len(texts):
            after = texts[end] if hosts[end] == hosts[start] else None
        else:
            after = outside.get(True)
        other = before if before is not None else after
        # Copies in a row may differ in their markup.
        lost = {kind: template_lines(texts[start], other, kind) for kind in set(prose[start:end])}
        out += [(names[i], lost[prose[i]]) for i in range(start, end) if lost[prose[i]]]
    return pa.table({"row": pa.array([row for row, _ in out], pa.int64()), "lost": pa.array([n for _, n in out], pa.list_(pa.int64()))})


# Characters of a range; a range is one task and one group.
RANGE_CHARS = 8 << 20
SCHEMA = "page_id long, url string, text string, n_chars long"
PLACES = ("part long, place long, row long, host string, lines binary, prose string, "
          "edge struct<first_host: string, first: string, second: long, last_host: string, last: string, prior: long>")


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``: one row per page.

    Null and empty pages have an empty text; a page without a different neighbour on its
    host loses only what the markup excludes; a null URL is a host of its own.  Copies
    in a row meet the same neighbour, so they keep the same text; repeated rows stay and
    other columns don't matter.
    """
    plain = pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")
    )
    parsed = plain.mapInArrow(_parsed, SCHEMA + ", declared boolean, lines binary, prose string")
    parsed = stored(parsed.withColumn("row", F.monotonically_increasing_id()), "page-blocks")
    link = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.concat(F.when(F.col("declared"), "+").otherwise("-"), F.lower(F.regexp_extract(link, r"^[^/?#]*", 0)))
    keyed = parsed.select("row", "page_id", "url", "lines", "prose", host.alias("host"),
                          F.regexp_extract(link, r"^[^/?#]*([^?#]*)", 1).alias("path"))
    volume = parsed.agg(F.sum(F.col("n_chars") + 64)).first()[0] or 0
    # Repeated rows are told apart by the row's number, so that they can be dealt to several ranges.
    sort = ["host", "path", "url", "page_id", F.xxhash64("lines"), "row"]
    dealt = keyed.repartitionByRange(max(1, round(volume / RANGE_CHARS)), *sort).sortWithinPartitions(*sort)
    placed = stored(dealt.select("row", "host", "lines", "prose").mapInArrow(_placed, PLACES), "page-ranges")
    pages_of = placed.where("edge IS NULL")
    # One row a range.
    edges = beyond(placed.where("edge IS NOT NULL").select("part", "place", "edge").orderBy("part").collect())
    asked = pages.sparkSession.createDataFrame(edges, "for_part long, later boolean, part long, place long")
    brought = stored(
        pages_of.select("part", "place", "lines").join(asked, ["part", "place"]).select(F.col("for_part").alias("part"), "later", "lines"),
        "page-beyond")
    differenced = pages_of.drop("edge").groupBy("part").cogroup(brought.groupBy("part")).applyInArrow(
        _differenced, "row long, lost array<long>")
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("lost", i.cast("long")))
    text = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return parsed.join(stored(differenced, "page-template"), "row", "left").select(
        "page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
