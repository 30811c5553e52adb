"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over training time. Its integral is the
source's weight, from which its target in words follows. The words a source
supplies, its documents in a fixed shuffled order and repeated as often as
needed, are laid along its demand; the inverse of the cumulative demand gives
each copy of a document its training position, by which the copies are sorted.

DataFrame operations only. No source is gathered in one task: its documents are
dealt into blocks by hash, as many as the number of rows asks for, sums by block
give each block its start, and running sums stay within blocks. Planning runs on
rows without their texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointspark.llm.names import free_names
from pointspark.session import materialize

#: Weights over training time from 0 to 1, straight between the knots; the list of weights repeats over the sources.
SCHEDULE = ((0.0, (6.0, 2.0, 0.5)), (0.5, (5.0, 2.0, 1.0)), (1.0, (4.0, 2.0, 1.5)))
#: How often a document may be repeated.
REPEATS = 3
#: Parts into which rows without an id are dealt besides, as their hashes may all be one.
SALTS = 64

#: A run of words with what stands around it, as one character when replaced.
WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII whitespace; 0 for null."""
    squeezed = F.length(F.regexp_replace(text, WORD, "w"))
    # a text of whitespace alone is left as it is
    return F.when(F.coalesce(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == "", 0).otherwise(squeezed).cast("long")


def integrals(schedule) -> tuple[float, ...]:
    """The area under each weight's schedule."""
    steps = list(zip(schedule, schedule[1:], strict=False))
    return tuple(sum((t1 - t0) * (a[i] + b[i]) / 2 for (t0, a), (t1, b) in steps) for i in range(len(schedule[0][1])))


def position_at(share: Column, schedule, i: int) -> Column:
    """The time by which weight i has asked for the given share of its whole demand."""
    area, done, out = integrals(schedule)[i], 0.0, None
    for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False):
        rate, slope = a[i], (b[i] - a[i]) / (t1 - t0)
        part = (t1 - t0) * (a[i] + b[i]) / 2
        # rate * x + slope / 2 * x^2 = q, in the form that stays exact for slope 0
        q = F.greatest(share * F.lit(area) - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(rate * rate) + F.lit(2 * slope) * q, F.lit(0.0)))
        x = F.coalesce(F.try_divide(2 * q, F.lit(rate) + root), F.lit(0.0))
        here = F.least(F.lit(t0) + x, F.lit(t1))
        out = here if out is None else F.when(share * F.lit(area) < F.lit(done), out).otherwise(here)
        done += part
    return out


def targets(sources: DataFrame, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """sources (sk, sn, source_size) with cycle (which weight) and target.

    The windows run over one row a source. Among sources in the order of what
    they can give for their weight, the level at which the words are spent is
    the largest of (words left) / (weight left); a target is weight times level
    or all that its source can give.
    """
    ranked = sources.withColumn("cycle", ((F.row_number().over(Window.orderBy("sn", "sk")) - 1) % len(weights)).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("cycle") + 1)).withColumn("most", F.col("source_size") * F.lit(repeats))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "sn", "sk")
    total, whole = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(Window.partitionBy())
    before = lambda c: F.sum(c).over(by_ratio) - F.col(c)
    level = ranked.withColumn("level", F.try_divide(total - before("most"), whole - before("weight")))
    return level.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.max("level").over(Window.partitionBy()))).select("sk", "sn", "source_size", "cycle", F.col("target").cast("double"))


def mixing_plan(docs: DataFrame, schedule=SCHEDULE, repeats: int = REPEATS, blocks: int | None = None, whole: bool = False, carried: tuple[str, ...] | None = None) -> tuple[DataFrame, list[str]]:
    """The carried columns of docs (all, unless named) with what the mix takes of each row, and the names of the added columns:
    size, source_size, target, taken (words) and positions (array<double>, one for each copy, ascending).

    A size is a number of words. Sources stand by code point, null last, and
    take the schedule's weights in turn. All sizes together are shared by
    weight; a source gives at most repeats times its size and what is above is
    shared among the others. A copy that the demand reaches only in part counts
    with that part; whole takes it in full from half on, else not at all.

    Null and empty texts have size 0 and are never taken; texts are counted
    whole, however long, and once. Null doc_ids and repeated rows are rows like
    any other. The order inside a source comes from a hash of doc_id and text,
    so reruns agree, however the input is split; rows without an id that are
    equal in all that is carried have a number each besides. An empty table gives no rows. There are as many blocks as the
    square root of the number of rows, unless told, so neither the rows of a
    block nor the blocks of a source are many.
    """
    kept = list(docs.columns if carried is None else carried)
    size, source_size, target, taken, positions, sk, sn, order, block, before, copies, salt = free_names(kept, "size", "source_size", "target", "taken", "positions", "sk", "sn", "mix_order", "mix_block", "mix_before", "mix_copies", "mix_salt")
    unnamed = free_names(docs.columns, "mix_unnamed")[0]
    base = docs.select(*kept, word_count(F.col("text")).alias(size), F.coalesce("source", F.lit("")).alias(sk), F.col("source").isNull().alias(sn), F.xxhash64("doc_id", "text").alias(order), F.col("doc_id").isNull().alias(unnamed))
    base = materialize(base, "sizes")
    # rows without an id that are equal in all that is carried are counted and numbered, so that many of them do not meet in one block
    same = base.where(unnamed).groupBy(*base.columns).agg(F.count("*").alias(salt))
    same = same.withColumn(salt, F.explode(F.sequence(F.lit(1).cast("long"), F.col(salt))))
    base = base.where(~F.col(unnamed)).withColumn(salt, F.lit(0).cast("long")).unionByName(same).drop(unnamed)
    n_blocks = blocks or max(1, math.isqrt(base.count()))
    base = base.withColumn(block, F.pmod(F.xxhash64(F.lit(1), order, salt), F.lit(n_blocks)).cast("int"))
    sums = base.select(F.col(sk).alias("sk"), F.col(sn).alias("sn"), F.col(block).alias("block"), F.col(size).alias("size")).groupBy("sk", "sn", "block").agg(F.sum("size").alias("size"))
    sums = materialize(sums, "block-sizes")
    by_source = targets(sums.groupBy("sk", "sn").agg(F.sum("size").alias("source_size")), integrals(schedule), repeats)
    starts = sums.withColumn("before", F.sum("size").over(Window.partitionBy("sk", "sn").orderBy("block")) - F.col("size"))
    ready = starts.drop("size").join(by_source, ["sk", "sn"])
    ready = ready.select(F.col("sk").alias(sk), F.col("sn").alias(sn), F.col("block").alias(block), F.col("before").alias(before), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("cycle").alias(copies))
    joined = base.join(ready, [sk, sn, block])
    within = Window.partitionBy(sk, sn, block).orderBy(order, salt, size, F.xxhash64(*kept)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = joined.withColumn(before, F.col(before) + F.sum(size).over(within) - F.col(size))
    goal = F.round(F.col(target)).cast("long")
    each = []
    for e in range(repeats):
        start = F.lit(e) * F.col(source_size) + F.col(before)
        words = F.least(F.greatest(goal - start, F.lit(0)), F.col(size))
        if whole:
            words = F.when(2 * words >= F.col(size), F.col(size)).otherwise(F.lit(0))
        share = F.coalesce(F.try_divide(start.cast("double"), goal.cast("double")), F.lit(0.0))
        at = F.lit(None).cast("double")
        for i in range(len(schedule[0][1])):
            at = F.when(F.col(copies) == i, position_at(share, schedule, i)).otherwise(at)
        each.append(F.struct(words.cast("long").alias("words"), at.alias("at")))
    joined = joined.withColumn(copies, F.filter(F.array(*each), lambda x: x["words"] > 0))
    out = joined.withColumns({taken: F.aggregate(copies, F.lit(0).cast("long"), lambda a, x: a + x["words"]), positions: F.transform(copies, lambda x: x["at"])})
    return out.select(*kept, size, source_size, target, taken, positions), [size, source_size, target, taken, positions]


def mix(docs: DataFrame, schedule=SCHEDULE, repeats: int = REPEATS, blocks: int | None = None) -> DataFrame:
    """The copies of docs that the mix takes, whole and with docs' columns, range-sorted by training position.

    Documents of size 0 ask for no demand and are left out. See mixing_plan for
    the rest. Positions and the part of the range that they fall in are found on
    rows without texts; texts then go to their rows, and with them to that part.
    """
    key, at, part, id_, row = free_names(docs.columns, "row_key", "position", "range_part", "planned_id", "planned_key")
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns))
    slim = keyed.select("doc_id", "text", "source", F.col("doc_id").alias(id_), F.col(key).alias(row))
    plan, (_, _, _, _, positions) = mixing_plan(slim, schedule, repeats, blocks, whole=True, carried=("doc_id", id_, row))
    copies = plan.select(id_, row, F.explode(positions).alias(at))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = materialize(copies.repartitionByRange(parts, at, row).withColumn(part, F.spark_partition_id()), "positions")
    # rows that are equal in every column are one text, which all their copies meet
    if slim.select(id_, row).groupBy(id_, row).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["doc_id", key])
    out = keyed.join(copies, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(row)))
    return out.repartitionById(parts, part).sortWithinPartitions(at, key).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    plan, _ = mixing_plan(docs, carried=("doc_id",))
    slim = materialize(plan.select("doc_id", "size", "source_size", "target", "taken", F.element_at("positions", F.when(F.size("positions") > 0, 1)).alias("position")), "mix")
    return slim.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


QUERIES = {"op2_mixing": op2_mixing}
SQL: dict[str, str] = {}
