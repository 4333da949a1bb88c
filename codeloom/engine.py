"""Repositories indexed, kept up to date and asked: the operators put together (O-20, O-71, O-178, O-192)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from codeloom import config as settings
from codeloom.extract.chunks import chunk_files
from codeloom.functions.text import embedding_text
from codeloom.operators import changes, graphs, history, imports, ranking, reports, search, toc
from codeloom.operators.store import ChunkStore, filtered, search_view, stats
from codeloom.plans import pages, research
from codeloom.session import written
from codeloom.sources import trees
from codeloom.streaming import events as stream


class Engine:
    """The tables of one index under a path: ``files`` and ``chunks``. Settings are those in force when it is made (O-203)."""

    def __init__(self, spark: SparkSession, path: str, embedder: research.Embedder | None = None, config: settings.Config | None = None) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or settings.current()
        self.embedder = embedder or research.provider(self.config.embedding)
        self.store = ChunkStore(spark, f"{self.path}/chunks")

    def _chunks(self, files: DataFrame) -> DataFrame:
        c = chunk_files(files, "path", "source_text", self.config.class_split_lines)
        t = embedding_text(F.col("chunk_type"), F.col("name"), F.col("parent_name"), F.col("language"), F.col("docstring"), F.col("content"))
        return research.embedded(c.withColumn("_text", t), "_text", self.embedder).drop("_text")

    def _scan(self, root: str) -> DataFrame:
        c = self.config
        return trees.scan(self.spark, root, c.excluded, c.languages, c.max_file_size)

    def index(self, root: str, full: bool = False) -> dict[str, int]:
        """Scans a tree and brings the chunks up to date: hashes are compared first, and only added and changed files are worked on; removed ones go."""
        keep = written(self._scan(root).drop("source_text"), "files")
        try:
            before = None if full else written(self.files(), "before")
        except AnalysisException:  # no index yet
            before = None
        if before is None:
            self.store.create(self._chunks(self._scan(root)))
            status = {"added": keep.count(), "changed": 0, "unchanged": 0, "removed": 0}
        else:
            diff = written(changes.file_changes(keep, before), "diff")
            status = {"added": 0, "changed": 0, "unchanged": 0, "removed": 0} | {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
            gone = diff.where("status in ('removed', 'changed')").select(F.col("path").alias("file_path"))
            if status["removed"] + status["changed"]:
                self.store.delete_files(gone)
            if status["added"] + status["changed"]:
                todo = keep.join(diff.where("status in ('added', 'changed')").select("path"), "path", "left_semi")
                texts = trees.with_contents(todo, root).withColumn("source_text", F.decode("content", "UTF-8"))
                self.store.append(self._chunks(texts.select("path", "source_text")))
        keep.write.mode("overwrite").parquet(f"{self.path}/files")
        return status

    def chunks(self) -> DataFrame:
        return self.store.read()

    def search(self, question: str, k: int | None = None, language: str | None = None, chunk_type: str | None = None) -> DataFrame:
        """The chunks nearest to a question, as a search shows them (O-22, O-30)."""
        top = search.top_k(filtered(self.chunks(), language, chunk_type), self.embedder.embed([question])[0], k or self.config.search_limit, "id")
        return search_view(top).join(top.select("id", "score"), "id").orderBy(F.desc("score"), "id")

    def ask(self, question: str, generator: research.Generator | None = None, preset: str | None = None) -> dict:
        return research.Research(self.chunks(), self.embedder, generator or research.provider(self.config.generator), preset or self.config.preset).run(question)

    def research(self, question: str, generator: research.Generator, preset: str = "thorough", cancelled=lambda: False):
        """The run of a question as server-sent events."""
        return research.events_of(research.Research(self.chunks(), self.embedder, generator, preset, cancelled), question)

    def glossary(self) -> DataFrame:
        return reports.entities(self.chunks()).orderBy("letter", F.lower("name"), "file_path")

    def relationships(self, path: str) -> DataFrame:
        """Imports, importers and what shares modules with a file."""
        m = imports.of_chunks(self.chunks(), "file_path")
        rel = imports.relations(m, imports.module_files(m, self.files()))
        return imports.see_also(rel, imports.shared(m, "file_path", "module")).where(F.col("path") == path)

    def _dependencies(self) -> DataFrame:
        m = imports.of_chunks(self.chunks(), "file_path")
        return imports.relations(m, imports.module_files(m, self.files())).where("kind = 'imports'")

    def cycles(self) -> DataFrame:
        """Imports that lie on a cycle of files."""
        return graphs.cycle_edges(self._dependencies(), "path", "other")

    def _classes(self) -> DataFrame:
        c = self.chunks().where("chunk_type = 'class'")
        return c.select("name", "file_path", F.coalesce("metadata.parent_classes", F.array().cast("array<string>")).alias("parents"))

    def inheritance(self) -> DataFrame:
        """The trees of classes, with the place of each in a walk."""
        return graphs.tree(self._classes())

    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files")

    def changelog(self, logs: str) -> DataFrame:
        """Commits by day from the log files in a folder."""
        c = trees.git_logs(self.spark, logs)
        return history.commits_by_day(c.select(F.col("full_hash").alias("id"), "author", "ts", "file"))

    def pages(self, logs: str | None = None) -> DataFrame:
        """The pages of the index: path, content."""
        c, f = self.chunks(), self.files()
        out = [pages.file_pages(c), pages.glossary_pages(c), pages.coverage_page(c), pages.files_index(f)]
        if logs:
            out.append(pages.changelog_pages(trees.git_logs(self.spark, logs).select(F.col("full_hash").alias("id"), "author", "ts", "file")))
        return pages.assembled(out)

    def staleness(self, generated: DataFrame, days: int | None = None) -> DataFrame:
        """Pages (path, generated_at) of files against the times of these."""
        mine = self.files().select(pages.page_of(F.col("path")).alias("page"), F.col("last_modified").alias("at"))
        return changes.staleness(generated.select(F.col("path").alias("page"), "generated_at"), mine, days=self.config.stale_days if days is None else days)

    def toc(self) -> DataFrame:
        return toc.numbered(self.pages().select("path"))

    def search_index(self) -> DataFrame:
        return ranking.page_index(self.pages())

    def watch(self, events: DataFrame, root: str, checkpoint: str, quiet: str | None = None, once: bool = False):
        """Indexes a tree anew after each burst of events on its files."""
        bursts = stream.debounced(stream.touched(events), quiet or self.config.debounce)
        return stream.refreshing(bursts, lambda batch, k: self.index(root) if batch.limit(1).count() else None, checkpoint, once)

    def stats(self) -> DataFrame:
        return stats(self.chunks())

    def coverage(self) -> DataFrame:
        return reports.coverage(self.chunks(), "file_path")

    def entities(self) -> DataFrame:
        return ranking.entity_index(self.chunks())
