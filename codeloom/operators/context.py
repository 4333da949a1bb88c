"""Where entities are used, and what belongs to a page (O-19, O-62, O-80 to O-82, O-86, O-87, O-119, O-156, O-163)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_FILES = 10


def used_words(chunks: DataFrame, *keys: str) -> DataFrame:
    """Identifiers of four letters or more in each file's chunks, once: the tokens that joins on names go by."""
    w = F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_]\w{3,}"), F.lit(0)))
    return chunks.select(*keys, F.explode(w).alias("word")).distinct()


def called_words(chunks: DataFrame, *keys: str) -> DataFrame:
    """Identifiers of four letters or more that an opening parenthesis follows, per file."""
    w = F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_]\w{3,})\s*\("), F.lit(1)))
    return chunks.select(*keys, F.explode(w).alias("word")).distinct()


def callers(entities: DataFrame, chunks: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """Other files that call an entity, the first ``most`` by path: file_path, name, caller_file, at (O-80). An equi-join on called words, not a search of every text."""
    e = entities.where(F.length("name") >= 4).select("file_path", "name").distinct()
    j = e.join(called_words(chunks, "file_path").select(F.col("file_path").alias("caller_file"), F.col("word").alias("name")), "name").where(F.col("file_path") != F.col("caller_file"))
    w = Window.partitionBy("file_path", "name").orderBy("caller_file")
    return j.withColumn("at", F.row_number().over(w)).where(F.col("at") <= most)


def used_types(chunks: DataFrame, classes: DataFrame, most: int = 10) -> DataFrame:
    """Types named after ``:`` or ``->`` in a file that are classes of the table: file_path, name, class_file (O-82)."""
    t = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?::|->)\s*([A-Z][A-Za-z0-9]{3,})"), F.lit(1)))
    u = chunks.select("file_path", F.explode(t).alias("name")).distinct()
    c = classes.groupBy("name").agg(F.min("file_path").alias("class_file"))
    w = Window.partitionBy("file_path").orderBy("name")
    return u.join(c, "name").withColumn("at", F.row_number().over(w)).where(F.col("at") <= most).drop("at")


def examples(entities: DataFrame, tests: DataFrame, per_file: int = 2, most: int = 5) -> DataFrame:
    """Test bodies that use an entity: at most two of a test file, equal code once, five in all (O-62, O-87). entities: name; tests: test_file, test_name, code."""
    t = tests.where(F.length("code") >= 10).select("test_file", "test_name", "code")
    words = t.select("*", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("name"))
    j = entities.select("name").distinct().join(words, "name").groupBy("name", "code").agg(F.min(F.struct("test_file", "test_name")).alias("x")).select("name", "code", "x.*")
    j = j.withColumn("k", F.row_number().over(Window.partitionBy("name", "test_file").orderBy("test_name", "code"))).where(F.col("k") <= per_file)
    return j.withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy("test_file", "test_name"))).where(F.col("at") <= most).drop("k")


def mock_heavy(code):
    """Two or more signs of mocking in a text (O-60)."""
    signs = ("mock", "Mock", "patch(", "MagicMock", "monkeypatch", "side_effect")
    return sum(F.contains(code, F.lit(s)).cast("int") for s in signs) >= 2


def test_files(files: DataFrame) -> DataFrame:
    """(path, test_path): tests of a Python file by name: test_<b>.py, test_<b>_*.py, <b>_test.py under test or tests (O-19)."""
    base = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"\.py$", "")
    py = files.where(F.col("path").endswith(".py"))
    tests = py.where(F.col("path").rlike(r"(^|/)tests?/")).select(F.col("path").alias("test_path"), base(F.col("path")).alias("t"))
    named = tests.where("t like 'test\\_%'").select("test_path", F.substring("t", 6, 1000).alias("t")).unionByName(tests.where("t like '%\\_test'").select("test_path", F.regexp_replace("t", "_test$", "").alias("t")))
    prefixes = named.select("test_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("t", "_"))), lambda k: F.array_join(F.slice(F.split("t", "_"), 1, k), "_"))).alias("b")).distinct()
    src = py.where(~F.substring_index("path", "/", -1).startswith("test_")).select("path", base(F.col("path")).alias("b"))
    return src.join(prefixes, "b").where(F.col("path") != F.col("test_path")).select("path", "test_path").distinct()


def heading_chunks(headings: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk of each heading of a page (O-86): by qualified name, then by name within the class of the page or free, then by class.

    headings: page, at, name, class (of the heading above, or null), file_path; chunks: id, file_path, name, parent_name, chunk_type.
    """
    c = chunks.where("name is not null").select("id", "file_path", "name", "parent_name", "chunk_type")
    h = headings.withColumn("simple", F.substring_index("name", ".", -1))
    j = h.join(c.withColumnRenamed("name", "simple"), ["file_path", "simple"])
    qualified = F.col("name") == F.concat_ws(".", "parent_name", "simple")
    rank = F.when(qualified & F.col("parent_name").isNotNull(), 1).when(F.col("parent_name").isNull() & (F.col("chunk_type") != "class") | F.col("parent_name").eqNullSafe(F.col("class")), 2).when(F.col("chunk_type") == "class", 3)
    w = Window.partitionBy("page", "at").orderBy("rank", "id")
    return j.withColumn("rank", rank).where("rank is not null").withColumn("_at", F.row_number().over(w)).where("_at = 1").select("page", "at", "name", "id")


def unused_chunks(chunks: DataFrame, used: DataFrame) -> DataFrame:
    """Chunks that no heading took (O-119)."""
    return chunks.join(used.select("id"), "id", "left_anti")
