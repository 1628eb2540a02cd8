"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each document gets a rate of copies between 0 and 2. Among all rates that meet the token constraints
``sum of rate x size = target`` of every source, the ones nearest to one copy each (in bounded entropy) are
``2 / (1 + exp(-lambda x size / scale))``: exponentially tilted odds with one dual variable lambda a source. Newton's
method on the convex dual finds the lambdas; every iteration is a distributed aggregate over the counts of
(source, size). The rates are then rounded into whole copies so that the totals stay near the targets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import materialise, quoted

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Newton steps at most, the relative miss of a token constraint at which they end, and the digits of a tilt kept.
STEPS, TOLERANCE, DIGITS = 100, 1e-6, 10
#: Documents of equal source and size are ranked in groups of about so many.
RANK_GROUP = 512
#: Running sums are whole numbers of this fraction of a copy: they don't depend on how rows are dealt to tasks.
UNIT = 1 << 20


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"),
    )


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the sums of all rows before each one, within its group: columns of the names in ``sums``.

    df is dealt to ranges of (group, order), whatever the size of a group. Within a range windows add up; what stands
    before a range are the totals of those before it, one row for each range and group in it. Sums of whole numbers
    are exact; order and group must tell rows apart.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).asc_nulls_last() for g in group]
    ranged = df.repartitionByRange(n, *keys, *order) if group or order else df
    dealt = materialise(ranged.withColumn("range__", F.spark_partition_id()), "mix-ranges")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = ahead(Window.partitionBy("range__", *group).orderBy(*order))
    within = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{k}__") for k, c in sums.items()])
    totals = dealt.groupBy("range__", *group).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    ranges = ahead(Window.partitionBy(*(group or [F.lit(0)])).orderBy("range__"))  # a row for each range (and group in it)
    bases = totals.select(F.col("range__").alias("of__"), *[F.col(g).alias(f"{g}__g") for g in group], *[F.coalesce(F.sum(k).over(ranges), F.lit(0)).alias(f"{k}__b") for k in sums])
    same = F.col("range__") == F.col("of__")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}__g"))
    joined = within.join(bases, same)
    return joined.select(*df.columns, *[(F.col(f"{k}__") + F.col(f"{k}__b")).alias(k) for k in sums])


def source_targets(hist: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """source, source_size, target from the counts of (source, size, n).

    Sources in code point order, null last, take the weights in turn. A source is full at MOST_COPIES times its size;
    what it can't take is shared again by weight. Sorted by (cap / weight), the full sources come first, so the water
    level is that of the first source in this order which stays below its cap.
    """
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    placed = running(totals, [], [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    capped = placed.select("source", "source_size", pick.alias("weight"), (F.col("source_size") * MOST_COPIES).alias("cap"))
    whole = capped.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if whole["size"] is None:
        return capped.select("source", "source_size", F.lit(None).cast("double").alias("target"))
    height = F.col("cap") / F.col("weight")
    filled = running(capped, [], [height.asc(), F.col("source").asc_nulls_last()], {"filled": F.col("cap"), "passed": F.col("weight")})
    leveled = filled.withColumn("level", (F.lit(whole["size"] * float(share)) - F.col("filled")) / (F.lit(whole["weight"]) - F.col("passed")))
    # the first source whose cap lies above its level sets the level of all after it
    water = leveled.agg(F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(height.alias("height"), "passed", "level")))["level"].alias("water")).first()["water"]
    target = F.col("cap").cast("double") if water is None else F.least(F.col("cap").cast("double"), F.lit(water) * F.col("weight"))
    return capped.select("source", "source_size", target.alias("target"))


def _rate(tilt: Column, size: Column, scale: Column) -> Column:
    return MOST_COPIES / (1 + F.exp(-tilt * size / scale))


def dual_tilts(hist: DataFrame, targets: DataFrame) -> DataFrame:
    """source, scale, tilt: safeguarded Newton on the dual of each source, all sources in each distributed step.

    Null where the target is 0 or the full 2 copies: there the rate is that bound itself. Each iterate is a small
    table of one row a source in the shared folder. Tilts are rounded, so that the order of sums leaves no trace in
    them. Raises if the steps end before the constraints are met.
    """
    scales = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    inside = (F.col("target") > 0) & (F.col("target") < MOST_COPIES * F.col("source_size") * (1 - 1e-12))
    state = targets.join(scales, targets.source.eqNullSafe(scales.source)).select(
        targets.source, "source_size", "target", "scale", F.when(inside, F.lit(0.0)).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(1.0).alias("miss")
    )
    state = materialise(state, "mix-tilt")
    for _ in range(STEPS):
        cells = hist.join(state.filter("tilt IS NOT NULL").select(F.col("source").alias("of"), "tilt", "scale"), F.col("source").eqNullSafe(F.col("of")))
        rate = _rate(F.col("tilt"), F.col("size"), F.col("scale"))
        tokens = F.col("size") * F.col("n") * rate
        sums = cells.groupBy("of").agg(F.sum(tokens).alias("got"), F.sum(tokens * (1 - rate / MOST_COPIES) * F.col("size") / F.col("scale")).alias("slope"))
        gap = F.col("target") - F.col("got")
        low, high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap < 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") + F.when(F.col("slope") > 0, gap / F.col("slope"))
        # outside the bracket, halve it (or double the reach while one end is open)
        middle = F.when(low <= -1e6, F.least(F.col("tilt") * 2, F.lit(-1.0))).when(high >= 1e6, F.greatest(F.col("tilt") * 2, F.lit(1.0))).otherwise((low + high) / 2)
        stepped = F.when((newton > low) & (newton < high), newton).otherwise(middle)
        new = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source", "source_size", "target", "scale",
            F.when(F.col("got").isNull() | (F.abs(gap) <= TOLERANCE * F.col("target")), F.col("tilt")).otherwise(stepped).alias("tilt"),
            F.coalesce(low, "low").alias("low"), F.coalesce(high, "high").alias("high"), F.coalesce(F.abs(gap) / F.col("target"), F.lit(0.0)).alias("miss"),
        )
        state = materialise(new, "mix-tilt")
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= TOLERANCE:
            return state.withColumn("tilt", F.round("tilt", DIGITS))
    raise RuntimeError(f"the token constraints are not met after {STEPS} Newton steps")


def cell_copies(hist: DataFrame, tilts: DataFrame) -> DataFrame:
    """source, size, part, n, copies: whole copies of each cell, rounded so that sums stay near their expectation.

    hist counts (source, size, part). Down the sizes of a source, the copies of a cell are the difference of the
    rounded running sums of expected copies; so the token error telescopes to less than half the largest document.
    What is left is met in one cell of each class of sizes (quarters of a power of two), one class after the other,
    downwards, by as many copies more or fewer as come nearest; this leaves about the size of the smallest documents.
    """
    cells = hist.join(tilts.select(F.col("source").alias("of"), "source_size", "target", "scale", "tilt"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    bound = F.when(F.col("target") > 0, F.lit(float(MOST_COPIES))).otherwise(F.lit(0.0))
    cells = cells.withColumn("expected", F.col("n") * F.coalesce(_rate(F.col("tilt"), F.col("size"), F.col("scale")), bound))
    cells = cells.withColumn("units", F.round(F.col("expected") * UNIT).cast("bigint"))
    cells = running(cells, ["source"], [F.col("size").desc(), F.col("part")], {"before": F.col("units")})
    whole = lambda units: F.shiftright(units + UNIT // 2, UNIT.bit_length() - 1)
    cells = cells.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("n") * MOST_COPIES, whole(F.col("before") + F.col("units")) - whole(F.col("before")))).cast("bigint"))
    # the residual of a source, met by copies more or fewer in one cell of each class of sizes
    cells = cells.withColumn("class", F.floor(4 * F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int"))
    free = (F.col("size") > 0) & F.col("tilt").isNotNull()
    room = lambda spare: F.max(F.when(free & (spare > 0), F.struct((spare * F.col("size")).alias("words"), "size", "part", spare.alias("spare"))))
    classes = cells.groupBy("source", "class").agg(
        room(F.col("n") * MOST_COPIES - F.col("copies")).alias("up"), room(F.col("copies")).alias("down"),
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"),
    )
    walk = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "up", "down")), asc=False).alias("steps"), (F.first("target") - F.sum("taken")).alias("left"))
    start = "struct(cast(left AS double) AS left, cast(array() AS array<struct<size:bigint,part:int,by:bigint>>) AS flips)"
    change = lambda side, sign: f"""struct(s.left - {sign} * x.{side}.size * least(x.{side}.spare, cast(floor({sign} * s.left / x.{side}.size + 0.5) AS bigint)) AS left,
        concat(s.flips, array(struct(x.{side}.size AS size, x.{side}.part AS part, {sign} * least(x.{side}.spare, cast(floor({sign} * s.left / x.{side}.size + 0.5) AS bigint)) AS by))) AS flips)"""  # noqa: E731
    step = f"(s, x) -> CASE WHEN x.up IS NOT NULL AND s.left > x.up.size / 2 THEN {change('up', 1)} WHEN x.down IS NOT NULL AND -s.left > x.down.size / 2 THEN {change('down', -1)} ELSE s END"
    flips = walk.select(F.col("source").alias("of"), F.explode(F.expr(f"aggregate(steps, {start}, {step}).flips")).alias("f")).select("of", F.col("f.size").alias("at"), F.col("f.part").alias("in"), "f.by")
    joined = cells.join(flips, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("at")) & (F.col("part") == F.col("in")), "left")
    return joined.select("source", "size", "part", "n", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies"), "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken (= copies x size).

    size counts the runs of other than ASCII white space; null texts have 0. Null is a source of its own, the last.
    No document is taken more than twice. Which of equal (source, size) documents get the extra copy depends on the
    hash of doc_id alone, so reruns agree; rows that repeat a doc_id may share it out either way, with equal sums.
    An empty table gives an empty result; other columns of docs are not looked at.
    """
    rows = materialise(sized(docs), "mix-sizes")
    counts = materialise(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    tilts = dual_tilts(counts, source_targets(counts, weights, share))
    # many documents of one (source, size) are dealt to parts by their id's hash
    parts = counts.select(F.col("source").alias("of"), F.col("size").alias("at"), F.ceil(F.col("n") / RANK_GROUP).alias("parts"))
    dealt = rows.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("at")))
    order = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(7))
    dealt = dealt.select("doc_id", "source", "size", order.alias("h"), F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1))), F.col("parts")).cast("int").alias("part"))
    dealt = materialise(dealt, "mix-dealt")
    cells = cell_copies(dealt.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n")), tilts)
    cells = cells.select(F.col("source").alias("of"), F.col("size").alias("at"), F.col("part").alias("in"), "n", "copies", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id"))
    ranked = dealt.withColumn("rank", rank)
    out = ranked.join(cells, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("at")) & (F.col("part") == F.col("in")))
    each = F.floor(F.col("copies") / F.col("n"))
    mine = (each + (F.col("rank") <= F.col("copies") - each * F.col("n")).cast("int")).cast("bigint")
    return out.select("doc_id", "source", "size", "source_size", "target", mine.alias("copies"), (mine * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs; names of its columns don't matter."""
    of, copies, copy = (f"mix_{x}_{uuid.uuid4().hex}" for x in ("of", "copies", "copy"))
    takes = mix.filter("copies > 0").groupBy("doc_id").agg(F.max("copies").alias(copies)).withColumnRenamed("doc_id", of)
    joined = docs.join(takes, F.col("doc_id").cast("bigint").eqNullSafe(F.col(of)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*map(quoted, docs.columns))
