"""Mixing sources to target shares of a budget, by capped water-filling.

Each source of a mix starts with its share of the budget; one that can't supply it, even with each text used
``max_repeats`` times, is held at what it has, and what it leaves is handed to the others in proportion to their shares,
until no source is over its cap. A source's tokens over its supply are then whole repetitions of all its texts and a
fraction: a seeded hash orders the texts of each source, and those up to the fraction of its tokens are drawn once more.
The order is cut by a histogram of the hash, so no source is sorted and none is gathered in one task.

Equal texts under several ids are one text of their source, under its smallest id. Sources are matched without regard to
letter case and outer blanks; documents without a source or a text belong to none, but count for the budget. Shares of
null or below 0 count as 0, repetitions of null as 1.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import tokens
from codeloom.llm.common import rows_out
from codeloom.session import written

BUCKETS = 4096
MAX_TARGETS = 100_000


def source_key(source: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), F.lit(""))


def _count(batch: dict[str, list], tokenizer: str) -> Iterable[tuple]:
    count = tokens.counter(tokenizer).count
    for i, key, h, text in zip(batch["doc_id"], batch["key"], batch["hash"], batch["text"]):
        yield i, key, h, count(text)


def sized(documents: DataFrame, tokenizer: str = tokens.DEFAULT) -> DataFrame:
    """doc_id, key, hash of the text, tokens; documents without a text have no row."""
    d = documents.select("doc_id", source_key(F.col("source")).alias("key"), F.sha2("text", 256).alias("hash"), "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return rows_out(d, lambda b: _count(b, tokenizer), "doc_id bigint, key string, hash string, tokens bigint", scan=True)


def targets_of(targets: DataFrame) -> list[dict]:
    """The mixes, as the driver plans them; they are settings, and more than MAX_TARGETS rows are an error."""
    rows = targets.select("mix_name", "source", source_key(F.col("source")).alias("key"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("repeats"), F.coalesce("budget_ratio", F.lit(0.0)).alias("ratio")).distinct().limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError("more rows of targets than a driver should plan")
    return [r.asDict() for r in rows]


def supplies(sizes: DataFrame, targets: list[dict]) -> tuple[float, dict[str, tuple[int, int]]]:
    """Tokens of all documents; source -> tokens of its documents, tokens of its different texts. One pass; no more rows than the mixes have sources come to the driver, and one for all others."""
    keys = sorted({t["key"] for t in targets if t["key"]})
    named = F.when(F.col("key").isin(keys), F.col("key"))
    per_text = sizes.groupBy(named.alias("key"), "hash").agg(F.sum("tokens").alias("all"), F.first("tokens").alias("one"))
    per = per_text.groupBy("key").agg(F.sum("all").alias("all"), F.sum("one").alias("one")).collect()
    return sum(r["all"] or 0 for r in per), {r.key: (r["all"], r.one) for r in per if r.key is not None}


def water_fill(want: list[float], cap: list[float]) -> list[float]:
    """Amounts at most their caps, in proportion to ``want`` where not at the cap, that sum to the sum of ``want`` if the caps allow."""
    got, open_, rest = [0.0] * len(want), {k for k, w in enumerate(want) if w > 0}, float(sum(want))
    while open_:
        weight = sum(want[k] for k in open_)
        over = {k for k in open_ if want[k] / weight * rest >= cap[k]}
        if not over:
            for k in open_:
                got[k] = want[k] / weight * rest
            break
        for k in over:
            got[k] = cap[k]
            rest -= cap[k]
        open_ -= over
    return got


def planned(targets: list[dict], total: float, supply: dict[str, tuple[int, int]]) -> list[dict]:
    """Each row of the targets with: wanted tokens, cap (of documents), short (can't supply), tokens to draw, epochs over its different texts."""
    out = []
    for mix in sorted({t["mix_name"] for t in targets}, key=str):
        rows = sorted((t for t in targets if t["mix_name"] == mix), key=lambda t: str(t["source"]))
        want = [t["share"] * t["ratio"] * total for t in rows]
        have = [supply.get(t["key"], (0, 0)) for t in rows]
        for t, w, (all_, one), got in zip(rows, want, have, water_fill(want, [max(0, t["repeats"]) * one for t, (_, one) in zip(rows, have)])):
            out.append(t | {"wanted": w, "cap": float(max(0, t["repeats"]) * all_), "short": max(0, t["repeats"]) * all_ < w, "tokens": float(got), "epochs": got / one if one else 0.0})
    return out


def plan_table(documents: DataFrame, targets: DataFrame, tokenizer: str = tokens.DEFAULT) -> DataFrame:
    """The plan of each mix and source: mix_name, source, target_share, wanted, cap, short, tokens, epochs."""
    return _table(documents.sparkSession, _plan(sized(documents, tokenizer), targets))


def _plan(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    t = targets_of(targets)
    return planned(t, *supplies(sizes, t))


def _table(spark, rows: list[dict]) -> DataFrame:
    data = [(r["mix_name"], r["source"], r["key"], r["share"], r["wanted"], r["cap"], r["short"], r["tokens"], r["epochs"]) for r in rows]
    return spark.createDataFrame(data, "mix_name string, source string, key string, target_share double, wanted double, cap double, short boolean, tokens double, epochs double")


def draw(documents: DataFrame, targets: DataFrame, seed: int = 0, tokenizer: str = tokens.DEFAULT) -> DataFrame:
    """What each mix draws: mix_name, source, doc_id, repeats (at least 1), tokens of one use."""
    sizes = written(sized(documents, tokenizer), "mix-sizes")
    plan = _plan(sizes, targets)
    spark = documents.sparkSession
    texts = sizes.where(F.col("key").isNotNull()).groupBy("key", "hash").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"))
    order = F.xxhash64(F.lit(seed), "hash")
    texts = texts.select("key", "doc_id", "tokens", order.alias("order"), F.shiftrightunsigned(order, 52).cast("int").alias("bucket"))
    want = _table(spark, plan).where("epochs > 0").select("mix_name", "source", "key", "epochs")
    # where in the order the fraction ends, from the tokens by bucket: at most BUCKETS rows a source
    per = texts.groupBy("key", "bucket").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("upto", F.sum("t").over(upto)).withColumn("all", F.sum("t").over(Window.partitionBy("key")))
    cut = want.join(per, "key").withColumn("part", (F.col("epochs") - F.floor("epochs")) * F.col("all"))
    cut = cut.where(F.col("upto") > F.col("part")).groupBy("mix_name", "source", "key").agg(F.min(F.struct("bucket", (F.col("part") - F.col("upto") + F.col("t")).alias("room"))).alias("cut"))
    want = want.join(cut, ["mix_name", "source", "key"], "left").select("mix_name", "source", "key", F.floor("epochs").cast("int").alias("whole"), F.coalesce("cut.bucket", F.lit(BUCKETS)).alias("cut"), F.coalesce("cut.room", F.lit(0.0)).alias("room"))
    drawn = texts.join(F.broadcast(want), "key")  # as many rows as the targets have
    inner = Window.partitionBy("mix_name", "source").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = drawn.where(F.col("bucket") == F.col("cut")).withColumn("more", (F.sum("tokens").over(inner) <= F.col("room")).cast("int"))
    rest = drawn.where(F.col("bucket") != F.col("cut")).withColumn("more", (F.col("bucket") < F.col("cut")).cast("int"))
    both = at.unionByName(rest).withColumn("repeats", F.col("whole") + F.col("more"))
    return both.where("repeats > 0").select("mix_name", "source", "doc_id", "repeats", "tokens")


def shares(documents: DataFrame, targets: DataFrame, seed: int = 0, tokenizer: str = tokens.DEFAULT) -> DataFrame:
    """What each source of each mix got: mix_name, source, target_share, documents, uses, tokens, share."""
    got = draw(documents, targets, seed, tokenizer).groupBy("mix_name", "source").agg(F.count("*").alias("documents"), F.sum("repeats").alias("uses"), F.sum(F.col("repeats") * F.col("tokens")).alias("tokens"))
    t = targets.select("mix_name", "source", "target_share").distinct().join(got, ["mix_name", "source"], "left").fillna(0, ["documents", "uses", "tokens"])
    return t.withColumn("share", F.round(F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("mix_name")), F.lit(0)), 6))
