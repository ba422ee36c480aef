"""Mixing sources to target weights by Pfair scheduling. Native functions only.

Each source is cut into blocks of ``block_rows`` documents. Block ``i`` of a source of weight ``w`` is released at slot
``floor(i / w)`` and due by slot ``ceil((i + 1) / w)``; earliest deadline first fills the slots, one block each, so that
after every slot each source is less than one block away from its share. The schedule repeats after as many slots as the
shares sum to, so one cycle is made, on shares alone, and joined to the documents.

Weights that are whole numbers and sum to CYCLE or less are the shares, exactly; so are equal weights. Others are rounded to
whole slots of a cycle of CYCLE by largest remainders: then the bound holds for the rounded shares, each less than a slot of
CYCLE off its weight. A cycle has a slot for each source at least, so more sources than that are refused.

Documents are dealt by ranges of (source, order) and numbered by their place in a range, so a source that holds a third of
all rows is many ranges, whatever its order column holds.

Defined cases: documents without a source are a source of their own (null); a null order value comes first; ties and
repeated rows are told apart by ``content``, and equal rows may swap places; weights that are null, zero or negative count
as none given, which is one slot; weights of one source are summed; an empty table gives an empty one; a column that
clashes with an added one (``block``, ``slot``, ``mix_pos``, ``on_target``) is replaced. Every document is returned: slots
of a source that has run out stay empty, and ``on_target`` marks the slots before any source has run out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import broadcast_if_small, materialise

BLOCK_ROWS = 16
CYCLE = 1000
#: Counts of ranges are broadcast up to so many of them, joined by shuffle beyond.
BROADCAST_RANGES = 100_000


def _key(source: Column) -> Column:
    """Sources as non-null keys."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def shares(weights: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """(source, weight) to (_key, share): whole slots of a cycle, one at least. There are ``cycle`` sources at most, so all are one window."""
    whole = Window.partitionBy()
    given = weights.where(F.col("weight") > 0).groupBy(_key(F.col("source")).alias("_key")).agg(F.sum("weight").alias("w"))
    exact = F.min((F.col("w") == F.floor("w")).cast("int")).over(whole).cast("boolean") & (F.sum("w").over(whole) <= cycle)
    slots = F.col("w") / F.sum("w").over(whole) * cycle
    parts = given.select("_key", "w", exact.alias("exact"), F.floor(slots + 1e-9).alias("low"), (slots - F.floor(slots + 1e-9)).alias("rest"))
    left = F.lit(cycle) - F.sum("low").over(whole)
    more = F.row_number().over(whole.orderBy(F.desc(F.round("rest", 9)), "_key")) <= left
    return parts.select("_key", F.greatest(F.lit(1), F.when(F.col("exact"), F.col("w")).otherwise(F.col("low") + more.cast("int"))).cast("int").alias("share"))


def schedule(shares_: DataFrame) -> DataFrame:
    """(_key, share) to (_key, share, cycle, place, slot_in_cycle): earliest deadline first over one cycle, as a fold in one row.

    The input has a row for each source; ``interleave`` refuses more of them than a cycle has slots, so the fold is bounded by
    the cycle, not by the documents.
    """
    row = shares_.agg(F.array_sort(F.collect_list(F.struct("_key", "share"))).alias("s"), F.sum("share").cast("int").alias("q"))

    def step(acc: Column, t: Column) -> Column:
        done = acc["done"]
        due = F.transform(
            F.col("s"),
            lambda s, i: F.when(
                (F.get(done, i) < s["share"]) & (F.floor(F.get(done, i) * F.col("q") / s["share"]) <= t),
                F.struct(F.ceil((F.get(done, i) + 1) * F.col("q") / s["share"]).cast("int").alias("due"), i.alias("i")),
            ),
        )
        picked = F.transform(F.array(F.array_min(F.filter(due, lambda x: x.isNotNull()))["i"]), lambda p: F.struct(F.transform(done, lambda d, i: d + F.when(i == p, 1).otherwise(0)).alias("done"), F.concat(acc["picks"], F.array(p)).alias("picks")))
        return F.get(picked, F.lit(0))

    state = "struct<done:array<int>,picks:array<int>>"
    start = F.struct(F.transform("s", lambda s: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("picks")).cast(state)
    picks = row.where(F.size("s") > 0).select("s", "q", F.posexplode_outer(F.aggregate(F.sequence(F.lit(0), F.col("q") - 1), start, step)["picks"]).alias("slot_in_cycle", "i"))
    return picks.select(
        F.get("s", F.col("i"))["_key"].alias("_key"),
        F.get("s", F.col("i"))["share"].alias("_share"),
        F.col("q").alias("_cycle"),
        (F.row_number().over(Window.partitionBy("i").orderBy("slot_in_cycle")) - 1).alias("_place"),
        F.col("slot_in_cycle").alias("_slot"),
    )


def interleave(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    source: str = "source",
    order: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    cycle: int = CYCLE,
    content: tuple[str, ...] = (),
) -> DataFrame:
    """Adds ``block`` (of its source, from 0), ``slot``, ``mix_pos`` (the order to read in) and ``on_target`` to every document.

    ``weights`` has (source, weight), a row for each source (documents of other sources get a weight of one slot); without
    it all sources weigh the same. ``content`` names columns that order documents of equal ``order``.
    """
    docs = docs.drop("block", "slot", "mix_pos", "on_target").withColumn("_key", _key(F.col(source)))
    by = ["_key", F.col(order).asc_nulls_first(), *content]
    # written, since ranges are drawn anew each time; ids rise by one within a range, and the range is their upper part
    ranged = materialise(docs.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_range", F.shiftrightunsigned("_id", 33))
    counts = materialise(ranged.groupBy("_key", "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first")), "range-counts")
    totals = counts.groupBy("_key").agg(F.sum("_n").alias("_total"))
    have = totals.select("_key", F.lit(1).alias("share"))
    if (n := have.count()) > cycle:
        raise ValueError(f"{n} sources need a cycle of as many slots; it has {cycle}")
    if weights is None:
        share = have.select("_key", F.lit(max(1, cycle // max(1, n))).alias("share"))
    else:
        share = have.join(shares(weights, cycle).withColumnRenamed("share", "_given"), "_key", "left").select("_key", F.coalesce("_given", "share").alias("share"))
    plan = schedule(share)
    before = counts.select("_key", "_range", (F.sum("_n").over(Window.partitionBy("_key").orderBy("_range")) - F.col("_n") - F.col("_first")).alias("_shift"))
    # the first slot whose block its source can't fill
    place = F.col("_blocks") % F.col("_share")
    ends = totals.select("_key", F.floor(F.col("_total") / block_rows).alias("_blocks")).join(F.broadcast(plan), "_key").where(F.col("_place") == place)  # ``cycle`` rows
    end = ends.agg(F.min(F.floor(F.col("_blocks") / F.col("_share")) * F.col("_cycle") + F.col("_slot")).alias("_end"))
    numbered = ranged.join(broadcast_if_small(before, BROADCAST_RANGES), ["_key", "_range"]).withColumn("_no", F.col("_id") + F.col("_shift")).withColumn("block", F.floor(F.col("_no") / block_rows))
    plan = plan.select("_key", "_share", "_cycle", "_place", "_slot")
    sized = F.broadcast(plan.select("_key", "_share", "_cycle").distinct())  # ``cycle`` rows at most, as the next
    return (
        numbered.join(sized, "_key")
        .withColumn("_place", (F.col("block") % F.col("_share")).cast("int"))
        .join(F.broadcast(plan.select("_key", "_place", "_slot")), ["_key", "_place"])
        .withColumn("slot", F.floor(F.col("block") / F.col("_share")) * F.col("_cycle") + F.col("_slot"))
        .withColumn("mix_pos", F.col("slot") * block_rows + F.col("_no") % block_rows)
        .crossJoin(F.broadcast(end))  # one row
        .withColumn("on_target", F.col("slot") < F.col("_end"))
        .drop("_key", "_range", "_id", "_shift", "_no", "_share", "_cycle", "_place", "_slot", "_end")
    )


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS no, count(*) OVER (PARTITION BY source) AS total FROM documents),
src AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS i, count(*) OVER () AS n, any_value(total) AS total FROM d GROUP BY source),
sized AS (SELECT *, greatest(1, floor({CYCLE} / n))::BIGINT AS share FROM src),
conf AS (SELECT list(share ORDER BY i) AS shares, sum(share)::BIGINT AS q, count(*) AS n FROM sized),
sim AS (
  SELECT 0::BIGINT AS t, 0::BIGINT AS pick, list_transform(shares, lambda x: 0::BIGINT) AS done FROM conf
  UNION ALL
  SELECT t + 1, p, list_transform(range(1, n + 1), lambda k: done[k] + CASE WHEN k = p THEN 1 ELSE 0 END) FROM (
    SELECT t, done, n, q, list_min(list_transform(range(1, n + 1), lambda k: CASE
      WHEN done[k] < shares[k] AND (done[k] * q) // shares[k] <= t THEN (-((-(done[k] + 1) * q) // shares[k])) * 100000 + k ELSE 9000000000000000 END)) % 100000 AS p
    FROM sim, conf WHERE t < q)),
plan AS (SELECT pick AS i, t - 1 AS slot_in_cycle, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS place FROM sim WHERE t > 0),
ends AS (SELECT min(((s.total // {BLOCK_ROWS}) // s.share) * c.q + p.slot_in_cycle) AS fin FROM sized s, conf c, plan p WHERE p.i = s.i AND p.place = (s.total // {BLOCK_ROWS}) % s.share)
SELECT d.doc_id, d.source, (d.no // {BLOCK_ROWS})::BIGINT AS block,
  (((d.no // {BLOCK_ROWS}) // s.share) * c.q + p.slot_in_cycle)::BIGINT AS slot,
  ((((d.no // {BLOCK_ROWS}) // s.share) * c.q + p.slot_in_cycle) * {BLOCK_ROWS} + d.no % {BLOCK_ROWS})::BIGINT AS mix_pos,
  ((d.no // {BLOCK_ROWS}) // s.share) * c.q + p.slot_in_cycle < (SELECT fin FROM ends) AS on_target
FROM d JOIN sized s ON d.source IS NOT DISTINCT FROM s.source CROSS JOIN conf c JOIN plan p ON p.i = s.i AND p.place = (d.no // {BLOCK_ROWS}) % s.share
"""
