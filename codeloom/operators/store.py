"""The chunk table: creation, appending, deletion by file, lookups, statistics (O-20 to O-32)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from codeloom.functions import text
from codeloom.schemas import CHUNK_TYPES, LANGUAGES, SCHEMA_VERSION, checked
from codeloom.session import written

BUCKET_ROWS, MAX_BUCKETS = 100_000, 100_000
OWN = ("bucket", "schema_version")


def deduplicated(chunks: DataFrame, newest: str | None = None) -> DataFrame:
    """One row per id: the newest by a column, or any if rows of one id agree."""
    if newest is None:
        return chunks.dropDuplicates(["id"])
    w = Window.partitionBy("id").orderBy(F.col(newest).desc_nulls_last())
    return chunks.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


class ChunkStore:
    """Chunks in Parquet, in directories by a hash of the file path, so that a file is replaced by rewriting one of them.

    Data is never overwritten: every change writes new directories and then, at once, the list of those that count (by
    bucket). Readers go by the list they found; ``vacuum`` removes what no list names any more. The number of buckets
    follows the number of chunks when the table is made.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path, self._wanted = spark, path.rstrip("/"), buckets

    def _fs(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self) -> dict:
        """buckets, schema, and by bucket the directories that count: as many entries as there are buckets and changes since the last rewrite of each."""
        try:
            return json.loads(self.spark.read.text(f"{self.path}/current", wholetext=True).first()[0])
        except AnalysisException as x:
            raise FileNotFoundError(f"no chunks under {self.path}") from x

    def _publish(self, listed: dict) -> None:
        fs, part = self._fs(f"{self.path}/.current-{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
        _, to = self._fs(f"{self.path}/current")
        fs.delete(to, False)
        fs.rename(part, to)

    @staticmethod
    def _bucket(buckets: int):
        return F.pmod(F.xxhash64("file_path"), F.lit(buckets)).cast("int")

    def _write(self, chunks: DataFrame, buckets: int) -> dict[str, str]:
        """Bucket -> the directory written for it, rows in the order of paths, so that those of one path share row groups (O-27)."""
        at = f"data-{uuid.uuid4().hex}"
        b = chunks.withColumn("bucket", self._bucket(buckets)).withColumn("schema_version", F.lit(SCHEMA_VERSION)).withColumn("file_bucket", F.col("bucket"))
        b.repartition("file_bucket").sortWithinPartitions("file_bucket", "file_path", "id").write.partitionBy("file_bucket").parquet(f"{self.path}/{at}")
        fs, p = self._fs(f"{self.path}/{at}")
        names = [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()]
        return {n.split("=")[1]: f"{at}/{n}" for n in names}

    def create(self, chunks: DataFrame) -> None:
        """Replaces the table, also by an empty one (O-20)."""
        rows = written(deduplicated(chunks), "chunks")
        buckets = self._wanted or max(1, min(MAX_BUCKETS, -(-rows.count() // BUCKET_ROWS)))
        made = self._write(rows, buckets)
        schema = rows.schema.add("bucket", IntegerType()).add("schema_version", IntegerType())
        self._publish({"buckets": buckets, "schema": schema.jsonValue(), "data": {b: [d] for b, d in made.items()}})

    def _load(self, listed: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(listed["schema"])
        some = listed["data"].values() if buckets is None else [listed["data"].get(str(b), []) for b in buckets]
        at = [f"{self.path}/{d}" for ds in some for d in ds]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._load(self._list())

    def append(self, chunks: DataFrame) -> None:
        """Adds chunks whose id is not there yet (O-21)."""
        listed = self._list()
        new = deduplicated(chunks).join(self._load(listed).select("id"), "id", "left_anti")
        for b, d in self._write(new.select(*[c for c in StructType.fromJson(listed["schema"]).names if c not in OWN]), listed["buckets"]).items():
            listed["data"].setdefault(b, []).append(d)
        self._publish(listed)

    def _rewrite(self, files: DataFrame, add: DataFrame | None) -> None:
        listed = self._list()
        touched = [r[0] for r in files.select(self._bucket(listed["buckets"])).distinct().collect()]  # at most as many as there are buckets
        keep = self._load(listed, touched).join(files, "file_path", "left_anti").drop(*OWN)
        made = self._write(keep if add is None else keep.unionByName(add.select(keep.columns)), listed["buckets"])
        for b in map(str, touched):
            listed["data"].pop(b, None)
        listed["data"] |= {b: [d] for b, d in made.items()}
        self._publish(listed)

    def delete_files(self, files: DataFrame) -> None:
        """Removes the chunks of the files in ``file_path`` (O-25), rewriting the buckets they lie in."""
        self._rewrite(files.select("file_path").distinct(), None)

    def replace_files(self, chunks: DataFrame) -> None:
        """Puts the chunks of some files in the place of all that these files had."""
        self._rewrite(chunks.select("file_path").distinct(), deduplicated(chunks))

    def by_id(self, chunk_id: str) -> DataFrame:
        return self.read().where(F.col("id") == F.lit(chunk_id)).limit(1)

    def by_file(self, path: str) -> DataFrame:
        """The chunks of a file: only its bucket is read (O-24)."""
        listed = self._list()
        b = self.spark.createDataFrame([(path,)], "file_path string").select(self._bucket(listed["buckets"])).first()[0]
        return self._load(listed, [b]).where(F.col("file_path") == F.lit(path))

    def vacuum(self) -> None:
        """Removes the directories that the list does not name; no reader of an older list may be left."""
        used = {d for ds in self._list()["data"].values() for d in ds}
        fs, root = self._fs(self.path)
        for data in [x.getPath() for x in fs.listStatus(root) if x.getPath().getName().startswith("data-")]:
            mine = [x.getPath() for x in fs.listStatus(data) if x.isDirectory()]
            gone = [p for p in mine if f"{data.getName()}/{p.getName()}" not in used]
            for p in [data] if len(gone) == len(mine) else gone:
                fs.delete(p, True)


def filtered(chunks: DataFrame, language: str | None = None, chunk_type: str | None = None) -> DataFrame:
    """Equality filters, with values checked (O-63)."""
    checked(language, LANGUAGES, "language")
    checked(chunk_type, CHUNK_TYPES, "chunk type")
    for c, v in (("language", language), ("chunk_type", chunk_type)):
        if v is not None:
            chunks = chunks.where(F.col(c) == v)
    return chunks


def of_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of a list of files, in one pass (O-24)."""
    return chunks.join(files.select("file_path").distinct(), "file_path", "left_semi")


def stats(chunks: DataFrame) -> DataFrame:
    """Rows and files by language, by type and over all, in one pass: kind, value, chunks, files (O-26, O-89)."""
    g = chunks.groupingSets([[F.col("language")], [F.col("chunk_type")], []], "language", "chunk_type").agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "language").when(F.col("g") == 2, "chunk_type").otherwise("total")
    return g.select(kind.alias("kind"), F.when(F.col("g") == 1, F.col("language")).when(F.col("g") == 2, F.col("chunk_type")).alias("value"), "chunks", "files")


def embedding_texts(chunks: DataFrame) -> DataFrame:
    c = F.col
    return chunks.select("id", text.embedding_text(c("chunk_type"), c("name"), c("parent_name"), c("language"), c("docstring"), c("content")).alias("text"))


def search_view(chunks: DataFrame, size: int = 500) -> DataFrame:
    """What a search shows of a chunk (O-30, O-31, O-201)."""
    lines = F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("int").cast("string"))
    return chunks.select("id", "file_path", "name", F.col("chunk_type").alias("type"), "language", lines.alias("lines"), text.preview(F.col("content"), size).alias("preview"), "docstring")


def main_definitions(chunks: DataFrame, *by: str) -> DataFrame:
    """Per file the class that starts first, or if there is none the function: (start_line, end_line) (O-32)."""
    keys = list(by) or ["file_path"]
    w = Window.partitionBy(*keys).orderBy((F.col("chunk_type") == "class").desc(), F.col("start_line").asc_nulls_last(), "id")
    c = chunks.where(F.col("chunk_type").isin("class", "function"))
    return c.withColumn("_at", F.row_number().over(w)).where("_at = 1").select(*keys, "name", "chunk_type", "start_line", "end_line")
