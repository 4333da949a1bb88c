"""The registered queries of this folder, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm import answers, credentials, docpairs, mixing, neighbours, origins, packing, reading, splitting, syntax
from codeloom.plans.queries import LANGUAGE
from codeloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Over limits in characters, bytes and lines; the limits of the tables name no tokens for splitting.
ORACLES["p7_found"] = """WITH l AS (SELECT lower(language) AS language, arg_min(unit, limit_id) AS unit, arg_min(max_size, limit_id) AS most FROM size_limits WHERE purpose = 'split' GROUP BY 1)
SELECT DISTINCT c.id FROM code_chunks c LEFT JOIN l ON lower(c.language) = l.language LEFT JOIN l r ON r.language IS NULL
WHERE CASE coalesce(l.unit, r.unit) WHEN 'chars' THEN length(c.content) WHEN 'lines' THEN length(c.content) - length(replace(c.content, chr(10), '')) + 1 ELSE strlen(c.content) END > coalesce(l.most, r.most)"""
_USABLE = """c AS (SELECT DISTINCT ON (id) id, prompt, vector FROM llm_cache WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
u AS (SELECT id, prompt, list_transform(vector, lambda x: x::DOUBLE)::DOUBLE[64] AS v FROM c)"""
ORACLES["p4_found"] = f"""WITH {_USABLE}, n AS (SELECT a.id, b.id AS other, array_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.id <> b.id WHERE array_cosine_similarity(a.v, b.v) >= 0.9),
t AS (SELECT id, other FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, other) <= 5) SELECT DISTINCT least(id, other) AS id_1, greatest(id, other) AS id_2 FROM t"""
_NEAREST = """n AS (SELECT a.id, b.id AS other, round(array_cosine_similarity(a.v, b.v), 12) AS s, a.prompt, b.prompt AS other_prompt FROM q a JOIN u b ON a.id <> b.id)
SELECT id, CAST(row_number() OVER w AS INT) AS rank, other, round(s, 6) AS cosine, prompt, other_prompt FROM n WINDOW w AS (PARTITION BY id ORDER BY s DESC, other) QUALIFY row_number() OVER w <= 5"""
ORACLES["p4_neighbours"] = f"WITH {_USABLE}, q AS (FROM u), {_NEAREST}"
ORACLES["p4_search"] = f"WITH {_USABLE}, q AS (FROM u WHERE ('0x' || left(md5(id), 8))::BIGINT % 100 = 0), {_NEAREST}"
_KNOWN = "(" + ", ".join(f"'{x}'" for x in syntax.KNOWN) + ")"
ORACLES["p1_judged"] = f"""WITH f AS (SELECT file_id, min(repo) AS repo, min(coalesce(lower(language), {LANGUAGE})) AS lang FROM file_info WHERE file_id IS NOT NULL GROUP BY file_id)
SELECT repo, lang, count(*) AS files FROM f WHERE lang IN {_KNOWN} AND file_id IN (SELECT file_id FROM parse_results WHERE source_text IS NOT NULL) GROUP BY ALL"""
ORACLES["p2_checked"] = "SELECT 0 AS not_in_the_chunk, 0 AS without_name, 0 AS without_words, 0 AS of_unknown_chunks"
ORACLES["p3_checked"] = "SELECT DISTINCT id, length(content) AS chars, length(content) - length(replace(content, chr(10), '')) + 1 AS lines FROM code_chunks WHERE content IS NOT NULL"
_EDGE = r"[\s`*_\x{22}''()\[\]{}<>.\-–—?!:;,…#|/\\=~]+"
ORACLES["p5_empty"] = (
    rf"WITH t AS (SELECT DISTINCT id, trim(regexp_replace(coalesce(response, ''), '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{2060}}\x{{feff}}\x{{ad}}]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM llm_cache) SELECT id FROM t WHERE lower(regexp_replace(regexp_replace(regexp_replace(t, '(?s)^<(\w+)>\s*(.*?)\s*</\w+>$', '\2'), '^{_EDGE}', ''), '{_EDGE}$', '')) IN ("
    + ", ".join(f"'{x}'" for x in sorted(answers.NOTHING))
    + ")"
)
ORACLES["p7_checked"] = ORACLES["p7_found"].replace("SELECT DISTINCT c.id FROM", "SELECT DISTINCT c.id, length(c.content) AS chars, coalesce(c.start_line, 1) AS first_line, 0 AS over FROM")
ORACLES["p8_checked"] = "SELECT count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars, 0 AS over, 0 AS doubled, true AS few FROM documents WHERE text IS NOT NULL"
ORACLES["p9_checked"] = "SELECT mix_name, count(*) AS sources, 0 AS over_repeats, false AS over_budget, 0 AS of_other_sources FROM (SELECT DISTINCT mix_name, source FROM mix_targets) GROUP BY mix_name"
ORACLES["p10_grades"] = "SELECT doc_id, round(g.grade, 6) AS grade FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN (SELECT doc_id, avg(level) AS grade FROM reading_labels WHERE level BETWEEN 1 AND 4 GROUP BY doc_id) g USING (doc_id)"


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "file_info"), table(spark, d, "parse_results")).select("file_id")


@query
def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, d, "file_info"), table(spark, d, "parse_results"))


@query
def p1_judged(spark: SparkSession, d: str) -> DataFrame:
    """How many files of each repository and language were judged."""
    r = syntax.invalid_rates(table(spark, d, "file_info"), table(spark, d, "parse_results"))
    return r.where("repo is not null and lang is not null").select("repo", "lang", "files")


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_chunks(table(spark, d, "code_chunks"), table(spark, d, "size_limits")).select("id").distinct()


@query
def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_chunks(table(spark, d, "code_chunks"), table(spark, d, "size_limits"))


@query
def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of each chunk, without their overlap, give all of it back, from its first line on, and none is over its limit."""
    chunks, limits = table(spark, d, "code_chunks"), table(spark, d, "size_limits")
    before = F.lag("end_char", 1, 0).over(Window.partitionBy("id").orderBy("piece"))
    p = splitting.split_chunks(chunks, limits).withColumn("new", F.when(F.col("start_char") <= before, F.col("end_char") - before))
    g = p.groupBy("id").agg(F.sum("new").alias("chars"), F.min("start_line").alias("first_line"), F.max("size").alias("size"))
    most = splitting.oversized(chunks, limits).select("id", F.col("limit.max_size").alias("most")).distinct()
    return g.join(most, "id").select("id", "chars", "first_line", (F.col("size") > F.col("most")).cast("int").alias("over"))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(table(spark, d, "documents"), packing.capacity_of(table(spark, d, "size_limits")))
    return packed.where("pieces > 1").select("doc_id").distinct()


@query
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), packing.capacity_of(table(spark, d, "size_limits")))


@query
def p8_filling(spark: SparkSession, d: str) -> DataFrame:
    capacity = packing.capacity_of(table(spark, d, "size_limits"))
    return packing.filling(packing.pack(table(spark, d, "documents"), capacity), capacity)


@query
def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Texts and characters that got a place, overfull containers, places given twice, and whether there are few containers."""
    capacity = packing.capacity_of(table(spark, d, "size_limits"))
    packed = packing.pack(table(spark, d, "documents"), capacity)
    per = packed.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > capacity).alias("over"), (F.count_if(F.col("t") > 0) <= F.ceil(F.sum("t") / capacity) * 1.02 + 2).alias("few"))
    places = packed.groupBy("doc_id", "piece").agg(F.count("*").alias("n"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars"))
    texts = places.agg(F.countDistinct("doc_id").alias("texts"), F.sum("chars").alias("chars"), F.count_if(F.col("n") > 1).alias("doubled"))
    return texts.join(per)  # a row each


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.plan_table(table(spark, d, "documents"), table(spark, d, "mix_targets")).where("short").select("mix_name", "source")


@query
def p9_draw(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query
def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each mix: its sources, texts drawn too often, whether it is over its budget, and texts of other sources."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    plan = mixing.plan_table(docs, targets)
    most = targets.select("mix_name", "source", F.coalesce("max_repeats", F.lit(1)).alias("most")).distinct()
    own = docs.select("doc_id", mixing.source_key(F.col("source")).alias("own"))
    got = mixing.draw(docs, targets).join(most, ["mix_name", "source"]).join(own, "doc_id")
    used = got.groupBy("mix_name").agg(F.count_if(F.col("repeats") > F.col("most")).alias("over_repeats"), F.sum(F.col("repeats") * F.col("tokens")).alias("used"), F.count_if(~F.col("own").eqNullSafe(mixing.source_key(F.col("source")))).alias("of_other_sources"))
    mixes = plan.groupBy("mix_name").agg(F.count("*").alias("sources"), F.sum("wanted").alias("budget"))
    return mixes.join(used, "mix_name", "left").select("mix_name", "sources", F.coalesce("over_repeats", F.lit(0)).alias("over_repeats"), (F.coalesce("used", F.lit(0)) > F.col("budget") + 1).alias("over_budget"), F.coalesce("of_other_sources", F.lit(0)).alias("of_other_sources"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credentials(table(spark, d, "code_chunks"))


@query
def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(table(spark, d, "code_chunks"))


@query
def p3_checked(spark: SparkSession, d: str) -> DataFrame:
    """Characters and lines of every content as it comes out, masked or not."""
    c = table(spark, d, "code_chunks").where("content is not null").select("id", "content").distinct()
    out = c.join(credentials.redacted(table(spark, d, "code_chunks")).select("id", F.col("content").alias("masked")), "id", "left").withColumn("content", F.coalesce("masked", "content"))
    return out.select("id", F.length("content").alias("chars"), (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).alias("lines"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.names(table(spark, d, "code_chunks"))


@query
def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented(table(spark, d, "code_chunks")).distinct()


@query
def p2_checked(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose code is not in their chunk, does not hold their name or has no description, or whose chunk is unknown."""
    p = docpairs.documented(table(spark, d, "code_chunks")).join(table(spark, d, "code_chunks").select("id", "content").distinct(), "id", "left")
    return p.agg(F.count_if(~F.contains("content", "code")).alias("not_in_the_chunk"), F.count_if(~F.contains("content", "name")).alias("without_name"), F.count_if(~F.col("description").rlike("[^\\W\\d_]")).alias("without_words"), F.count_if(F.col("content").isNull()).alias("of_unknown_chunks"))


@query
def p2_origins(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by what their description comes from."""
    return docpairs.documented(table(spark, d, "code_chunks")).distinct().groupBy("origin").count()


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defects(table(spark, d, "llm_cache"))


@query
def p5_empty(spark: SparkSession, d: str) -> DataFrame:
    return answers.defects(table(spark, d, "llm_cache")).where("defect = 'empty'").select("id")


@query
def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    return answers.defects(table(spark, d, "llm_cache")).groupBy("defect").count()


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return origins.classified(table(spark, d, "file_info"), table(spark, d, "parse_results")).select("file_id")


@query
def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    return origins.classified(table(spark, d, "file_info"), table(spark, d, "parse_results")).groupBy("kind", "rule").count()


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).where(F.col("level") == reading.EXPERT).select("doc_id")


@query
def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


@query
def p10_grades(spark: SparkSession, d: str) -> DataFrame:
    """The mean grade of every document, as the levels take it."""
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", F.round("grade", 6).alias("grade"))


@query
def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return reading.profile(reading.levels(docs, table(spark, d, "reading_labels")), docs)


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(table(spark, d, "llm_cache"))


@query
def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar others of every usable entry, at any cosine, with their prompts."""
    t = table(spark, d, "llm_cache")
    prompts = t.select("id", "prompt").dropDuplicates(["id"])
    n = neighbours.nearest(t).withColumn("cosine", F.round("cosine", 6))
    return n.join(prompts, "id").join(prompts.toDF("other", "other_prompt"), "other")


@query
def p4_search(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of every hundredth entry by the hash of its id, which is no number, among all entries, at any cosine."""
    t = table(spark, d, "llm_cache")
    asked = t.where(F.conv(F.left(F.md5("id"), F.lit(8)), 16, 10).cast("bigint") % 100 == 0).select("id").distinct()
    prompts = t.select("id", "prompt").dropDuplicates(["id"])
    n = neighbours.search(t, asked).withColumn("cosine", F.round("cosine", 6))
    return n.join(prompts, "id").join(prompts.toDF("other", "other_prompt"), "other")
