"""Mixing sources to target weights: shares of words, repetition rates, and copies by a hash-seeded draw.

DataFrame functions only. Texts are counted where they are read and don't move; what is grouped is one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave import cluster
from arcweave.llm.words import WORD

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix"
#: Turns of the draw that are tried for each source; the one whose words come nearest to the target is used.
TURNS = 32
#: The plan is broadcast up to so many sources and characters of their names; beyond, the join is salted.
BROADCAST_SOURCES, BROADCAST_CHARS, SALTS = 50_000, 4_000_000, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1), a function of seed and doc_id only (a null id is one id): 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _turned(u: Column, turn: Column | int) -> Column:
    """The draw, turned around the circle: still uniform. Exact, since both are multiples of 2**-52."""
    x = u + (F.lit(turn) if isinstance(turn, int) else turn) / F.lit(float(TURNS))
    return x - F.floor(x)


def _copies(rate: Column, u: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(u < rate - whole, 1).otherwise(0)).cast("bigint")


def _numbered(sources: DataFrame) -> DataFrame:
    """Add ``place``: 0, 1, ... by code point, null last. Ranges first, so that no task sees all sources."""
    order = F.col("source").asc_nulls_last()
    n = cluster.shuffle_partitions(sources.sparkSession)
    ranges = cluster.checkpointed(sources.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over n rows at most
    offset = ranges.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranges.withColumn("place", within).join(offset, "part").withColumn("place", F.col("place") + F.col("offset")).drop("part", "offset")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for rows (source, size): ``share`` of all words dealt by weight, each source's part
    at most ``most`` times its size, what is over dealt again by weight to those below."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    plan = cluster.checkpointed(_numbered(totals).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("top")))
    whole = plan.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    if whole["w"] is None:
        return plan.select("source", "source_size", F.lit(0.0).alias("target"))
    level, full = share * whole["n"] / whole["w"], -1
    while True:  # the level only rises; each round some more sources are full, or it ends
        over = F.col("top") <= F.col("weight") * F.lit(level)
        row = plan.agg(
            F.count_if(over).alias("full"), F.coalesce(F.sum(F.when(over, F.col("top"))), F.lit(0.0)).alias("top"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open")
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (share * whole["n"] - row["top"]) / row["open"]
    return plan.select("source", "source_size", F.least(F.col("top"), F.col("weight") * F.lit(level)).alias("target"))


def _attach(rows: DataFrame, plan: DataFrame, columns: list[str]) -> DataFrame:
    """Join each row (with ``source``, ``doc_id``) to the plan of its source, null to null."""
    plan = plan.select(F.col("source").alias("_source"), *columns)
    size = plan.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("_source")), F.lit(0)).alias("chars")).first()
    if size["n"] <= BROADCAST_SOURCES and size["chars"] <= BROADCAST_CHARS:
        return rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    plan = plan.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_salt2"))
    return salted.join(plan, on).drop("_source", "_salt", "_salt2")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken (= size x copies).

    One row per input row; needs doc_id, text and source, and leaves other columns aside. size is the number of words;
    a null text has none. A source's rate is target / source_size; a document gets floor(rate) copies and one more if
    its draw is below the fraction. The draw depends on seed and doc_id alone, so that reruns agree; rows that share
    a doc_id share its fate. Each source's draws are turned around the circle by one of 32 multiples of 1/32: the one
    whose words come nearest to the target (the smallest of equals). Each turn by itself is a fair draw; choosing
    among them by outcome trades a little of that for a total near the target. A source without words has target 0
    and no copies. Null is a source of its own, the last. An empty table gives an empty one.
    """
    sized = cluster.staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    planned = _attach(sized, _plan(sized, weights, share, most, seed), ["source_size", "target", "rate", "turn"])
    copies = planned.withColumn("copies", _taken(seed))
    return copies.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _taken(seed: str) -> Column:
    """Copies of a row with doc_id, rate and turn."""
    return _copies(F.col("rate"), _turned(draw(F.col("doc_id"), seed), F.col("turn")))


def _plan(sized: DataFrame, weights, share, most, seed) -> DataFrame:
    """A row for each source: source, source_size, target, rate, turn."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = cluster.checkpointed(source_targets(sized, weights, share, most).withColumn("rate", rate))
    rated = _attach(sized, targets, ["source_size", "target", "rate"]).withColumn("u", draw(F.col("doc_id"), seed))
    tried = rated.groupBy("source").agg(
        *[F.first(c).alias(c) for c in ("source_size", "target", "rate")],
        *[F.sum(F.col("size") * _copies(F.col("rate"), _turned(F.col("u"), k))).alias(f"t{k}") for k in range(TURNS)],
    )
    miss = F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("d"), F.lit(k).alias("turn")) for k in range(TURNS)])
    return cluster.checkpointed(tried.select("source", "source_size", "target", "rate", F.array_min(miss)["turn"].alias("turn")))


def emit(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as ``mix`` takes it.

    Each source's rate and turn come from ``mix``'s plan, a row for each source; they are applied where a document is
    read, so that texts aren't shuffled (beyond BROADCAST_SOURCES sources they are, once). Cases as in ``mix``.
    """
    sized = cluster.staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    plan = _plan(sized, weights, share, most, seed)
    cluster.discard(sized)
    planned = _attach(docs.select(F.struct("*").alias("row"), "doc_id", "source"), plan, ["rate", "turn"])
    return planned.select("row", F.explode(F.array_repeat(F.lit(0), _taken(seed).cast("int")))).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                      CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, [3, 1, 2][place % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS top FROM totals),
sums AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS n, coalesce(sum(top) OVER w, 0) AS below,
                CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS others
         FROM weighed WINDOW w AS (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((1.5::DOUBLE * n - below) / others) FILTER (WHERE (1.5::DOUBLE * n - below) / others * weight < top) AS level FROM sums),
planned AS (SELECT source, source_size, CASE WHEN weight * level < top THEN weight * level ELSE top END AS target FROM weighed, level),
rated AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
          FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source),
turned AS (SELECT *, turn, u + turn / 32.0::DOUBLE AS x FROM rated, range(32) t(turn)),
tried AS (SELECT *, size * CAST(floor(rate) + CASE WHEN x - floor(x) < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM turned),
sources AS (SELECT source, turn, abs(sum(taken) - any_value(target)) AS miss FROM tried GROUP BY source, turn),
best AS (SELECT source, turn FROM sources QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, turn) = 1)
SELECT doc_id, size, source_size, target, taken
FROM tried t JOIN best b ON t.source IS NOT DISTINCT FROM b.source AND t.turn = b.turn
"""
