"""An archive: one nested table and the relational views and derived tables over it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import attachments as A
from colloquy.operators import browse, graph, project, search
from colloquy.session import complete_folders, materialize, scratch_path, write_table


@dataclass
class Archive:
    """``table`` has one row per record (see ``project_records``), ``files`` one row per
    classified attachment file.  Derived tables are computed once, on first use, and
    kept in the scratch folder, or in ``folder`` for later sessions too.
    """

    table: DataFrame
    files: DataFrame
    folder: str | None = None
    _derived: dict = field(default_factory=dict, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession

    @cached_property
    def conversations(self) -> DataFrame:
        return project.conversations(self.table)

    @cached_property
    def nodes(self) -> DataFrame:
        return project.nodes(self.table)

    @cached_property
    def search_documents(self) -> DataFrame:
        return project.search_documents(self.table)

    def _kept(self, name: str, build: Callable[[], DataFrame], write: Callable[[DataFrame, str], None] = write_table
              ) -> DataFrame:
        """A derived table as an earlier session stored it, or built and written now.

        Every writer takes a folder of its own, and only complete ones are read, so
        sessions that write the same table don't meet.
        """
        stored = complete_folders(self.spark, f"{self.folder}/{name}-*") if self.folder else []
        if stored:
            return self.spark.read.parquet(stored[0])
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:12]}" if self.folder else scratch_path(self.spark, name)
        rows = build()
        write(rows, path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @cached_property
    def links(self) -> DataFrame:
        return self._kept("links", lambda: graph.link_nodes(self.table))

    @cached_property
    def attachments(self) -> DataFrame:
        return self._kept("attachments", lambda: A.resolve_attachments(project.attachment_refs(self.table), self.files))

    @cached_property
    def postings(self) -> DataFrame:
        return self._kept("postings", lambda: search.postings(self.search_documents), search.write_postings)

    @property
    def roles(self) -> DataFrame:
        return project.node_rows(self.table, "role")

    @property
    def diagnostics(self) -> DataFrame:
        return project.diagnostics(self.table).unionByName(graph.cycle_diagnostics(self.table, self.links))

    @property
    def quarantine(self) -> DataFrame:
        return project.quarantine(self.table)

    def detail(self) -> DataFrame:
        return graph.conversation_detail(self.table, self.links, self.attachments)

    def search_words(self, text: str) -> list[list[str]]:
        """The words of each term of a search; sixteen terms at most."""
        asked = self.spark.createDataFrame([("q", text)], "query_id string, search string")
        return [r.words for r in search.search_terms(asked).orderBy("term_no").collect()]

    def list_conversations(self, query: browse.ConversationQuery) -> tuple[DataFrame, DataFrame]:
        """The page with its preview column, and the totals."""
        terms = self.search_words(query.search) if query.search else []
        rows = browse.filtered(
            query, self.conversations, self.attachments if query.attachment_kind else None,
            self.roles if query.role else None, search.one_search(self.postings, terms) if terms else None,
        )
        page = browse.page_of(rows, query)
        if terms:
            page = search.with_preview(page, self.search_documents, terms).orderBy(*browse.list_order())
        else:
            page = page.withColumn("match_preview", F.lit(None).cast("string"))
        return page, browse.page_summary(rows, query)


def build_archive(records: DataFrame, files: DataFrame) -> Archive:
    """Ingest records and classify attachment files, once."""
    return Archive(
        materialize(project.project_records(records), "archive"),
        materialize(A.classify_files(files), "files"),
    )


__all__ = ["Archive", "build_archive"]
