"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

Each source's documents form blocks of `block_docs`. At slot T a source's target is min(w * v, its blocks): v, the
virtual time, is the same for all sources and such that the targets add up to T, so when a source runs out
the rest go on in the same proportions. Block j of a source is released when its target passes j and due when it
passes j + 1, and earliest deadline first puts it in between: at any slot a source is less than one block away from
its exact target; weights are not rounded.

The schedule is laid out in rounds of `slots` slots, each on its own. Where a round begins every source has
had its target rounded up or down: the whole parts, and one more for as many of the largest fractions as the slots
still hold. That only works if a source's target grows by two blocks or more a round, so all sources that grow by less form
one pool, whose blocks are scheduled like a source's (its target is the sum of its members', rounded to the
nearest) and which is then mixed in the same way by its own clock. A member of a pool adds its part of the pool's
deviation to its own, which is under its share of the pool times one block.

Where a document goes follows from its number in its source and one join with the table of slots, one row
for each block. Nothing is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import materialize, placed

BLOCK_DOCS = 16
#: Slots of a round; with many sources it is four times their number.
SLOTS = 1024
TEMPERATURE = 0.5


def numbered(rows: DataFrame) -> DataFrame:
    """_file, _at, _s and _i, the number of each row of rows (_file, _at, _s, _id) in its source by id.

    A range partitioning by (source, id) cuts large sources over many tasks; the sizes of the
    parts, one row for each part and source, give the first number of each.
    """
    keys = ["_s", F.col("_id").asc_nulls_first(), "_file", "_at"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = materialize(dealt.withColumns({"_p": F.spark_partition_id(), "_l": F.monotonically_increasing_id()}), "mixing-sorted")
    parts = dealt.groupBy("_p", "_s").agg(F.count("*").alias("_n"), F.min("_l").alias("_from"))
    upto = W.partitionBy("_s").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))), "mixing-parts")
    return dealt.join(parts.drop("_n"), ["_p", "_s"]).select("_file", "_at", "_s", (F.col("_l") - F.col("_from") + F.col("_before")).alias("_i"))


def weighted(rows: DataFrame, weights: dict[str, float] | None, temperature: float, block_docs: int) -> DataFrame:
    """_s, blocks and w, the target weight, of each source."""
    each = rows.groupBy("_s").agg(F.count("*").alias("n"))
    if weights:
        if min(weights.values()) <= 0:
            raise ValueError("weights are greater than zero")
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (f"={k}", float(v))])
        weight = F.coalesce(F.try_element_at(given, F.col("_s")), F.lit(float(min(weights.values()))))
    else:
        weight = F.pow(F.col("n"), F.lit(temperature))
    return each.select("_s", F.ceil(F.col("n") / F.lit(block_docs)).alias("blocks"), weight.alias("w"))


def stretches(sources: DataFrame) -> DataFrame:
    """One row for each source, up to whose end (slot t) the virtual time grows evenly, from rho0 at slot t0, by one for each `rate` slots."""
    order = W.orderBy("rho", "_s")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    each = sources.withColumn("rho", F.col("blocks") / F.col("w"))
    each = each.withColumns({"done": F.sum("blocks").over(upto), "rate": F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))})
    each = each.withColumn("t", F.max(F.col("done") + F.col("rho") * (F.col("rate") - F.col("w"))).over(upto))
    return each.select("t", F.coalesce(F.lag("t").over(order), F.lit(0.0)).alias("t0"), F.coalesce(F.lag("rho").over(order), F.lit(0.0)).alias("rho0"), "rate")


#: The virtual time at slot {t}, from the stretches that a round touches.
TIME = "transform(array(coalesce(get(filter(near, x -> x.t >= {t}), 0), element_at(near, -1))), y -> y.rho0 + ({t} - y.t0) / y.rate)[0]"
#: The pool's target at a virtual time, and the targets of all: of each source that is scheduled by itself, then of the pool.
POOLED = "aggregate(_pool, 0D, (a, x) -> a + least(x.w * {v}, double(x.blocks)))"
TARGETS = f"concat(transform(_own, x -> least(x.w * {{v}}, double(x.blocks))), if(size(_pool) > 0, array({POOLED}), array()))"
#: Targets {a} in whole blocks that add up to {t}.
WHOLE = """transform(array(transform({a}, (x, i) -> if(i < size(_own), floor(x + 1e-9D), floor(x + 0.5D)))), f ->
  transform(array(transform(slice(array_sort(transform(slice({a}, 1, size(_own)), (x, i) -> struct(f[i] - x AS less, i AS i))), 1,
    int(greatest(0L, {t} - aggregate(f, 0L, (p, q) -> p + q)))), y -> y.i)), more -> transform(f, (x, i) -> x + if(array_contains(more, i), 1L, 0L)))[0])[0]"""
#: What each slot of a round must know when it ends: the virtual time, the pool's target and rate.
CLOCK = f"""transform(transform(sequence(t0 + 1, t1), t -> {TIME.format(t="t")}), v ->
  struct(v AS v, {POOLED.format(v="v")} AS pooled, aggregate(_pool, 0D, (a, x) -> a + if(x.w * v < x.blocks, x.w, 0D)) AS rate))"""
#: Who has which slot of a round and with which of its blocks: a fold over the slots. A source may have its next block from the slot
#: in which its target passes the block's number; of those that may, the one whose target passes the next number first has the slot.
EARLIEST_DEADLINE_FIRST = """
aggregate(
  clock,
  named_struct('done', n0, 'out', CAST(array() AS array<struct<i:int,j:bigint>>)),
  (st, at) -> transform(
    array(array_min(transform(st.done, (j, i) -> if(j >= n1[i], null, if(i < size(_own),
      if(j < _own[i].w * at.v - 1e-9D, struct(0 AS late, (j + 1) / _own[i].w AS due, i AS i), struct(1 AS late, j / _own[i].w AS due, i AS i)),
      struct(if(j < at.pooled - 1e-9D, 0, 1) AS late, at.v + (j + 1 - at.pooled) / greatest(at.rate, 1e-9D) AS due, i AS i)))))),
    p -> named_struct('done', transform(st.done, (j, i) -> if(i = p.i, j + 1, j)), 'out', concat(st.out, array(named_struct('i', p.i, 'j', st.done[p.i])))))[0],
  st -> st.out)
"""


def schedule(sources: DataFrame, own: DataFrame, pool: DataFrame, total: int, size: int) -> DataFrame:
    """_s (null for the pool), block and slot for each block of sources, which are own and pool together."""
    listed = lambda of, *names: of.agg(F.sort_array(F.collect_list(F.struct(*names)))).scalar()  # noqa: E731  one entry for each source
    kept = {"_own": listed(own, "_s", "blocks", "w"), "_pool": listed(pool, "_s", "blocks", "w"), "_ends": listed(stretches(sources), "t", "t0", "rho0", "rate")}
    each = sources.sparkSession.range(-(-total // size)).withColumns({**kept, "t0": F.expr(f"id * {size}"), "t1": F.expr(f"least((id + 1) * {size}, {total}L)")})
    each = each.withColumn("near", F.expr("filter(_ends, x -> x.t0 < t1 AND x.t >= t0)")).drop("_ends")
    each = each.withColumns({"v0": F.expr(TIME.format(t="t0")), "v1": F.expr(TIME.format(t="t1")), "clock": F.expr(CLOCK)})
    each = each.withColumns({"a0": F.expr(TARGETS.format(v="v0")), "a1": F.expr(TARGETS.format(v="v1"))})
    each = each.withColumns({"n0": F.expr(WHOLE.format(a="a0", t="t0")), "n1": F.expr(WHOLE.format(a="a1", t="t1"))})
    laid = each.select("t0", "_own", F.posexplode(F.expr(EARLIEST_DEADLINE_FIRST)).alias("at", "x"))
    return laid.select(F.expr("get(_own, x.i)._s").alias("_s"), F.col("x.j").alias("block"), (F.col("t0") + F.col("at")).alias("slot"))


def slot_table(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """_s, block and slot for each block of sources (a written table); level by level, each the pool of the one before."""
    rest, made, above = sources, None, None
    while True:
        n, total, w = rest.agg(F.count("*"), F.sum("blocks"), F.sum("w")).first()
        size = max(slots, 1 << (4 * n).bit_length())
        heavy = F.col("w") * size >= 2 * (w or 0.0)
        own, pool = rest.filter(heavy), rest.filter(~heavy)
        laid = schedule(rest, own, pool, total or 0, size)
        if above is not None:
            laid = laid.withColumnRenamed("slot", "_inner").join(above, "_inner").drop("_inner")
        laid = materialize(laid, "mixing-slots")
        single = laid.filter("_s IS NOT NULL")
        made = single if made is None else made.unionByName(single)
        if pool.isEmpty():
            return made
        above, rest = laid.filter("_s IS NULL").select(F.col("block").alias("_inner"), "slot"), pool


def positions(rows: DataFrame, weights: dict[str, float] | None, temperature: float, block_docs: int, slots: int) -> DataFrame:
    """_file, _at, block, block_position and position for each row of rows (_file, _at, _s, _id)."""
    rows = materialize(numbered(rows), "mixing-numbered")
    table = slot_table(materialize(weighted(rows, weights, temperature, block_docs), "mixing-sources"), slots)
    rows = rows.withColumn("block", F.expr(f"_i div {block_docs}")).join(table, ["_s", "block"])
    return rows.select("_file", "_at", "block", F.col("slot").alias("block_position"), (F.col("slot") * block_docs + F.expr(f"_i % {block_docs}")).alias("position"))


def keyed(docs: DataFrame) -> DataFrame:
    """_row, _file, _at, _s (the source, null apart) and _id of each row of docs."""
    label = F.coalesce(F.concat(F.lit("="), F.col("_row.source").cast("string")), F.lit(""))
    return placed(docs).select("_row", "_file", "_at", label.alias("_s"), F.col("_row.doc_id").alias("_id"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, block_docs: int = BLOCK_DOCS, slots: int = SLOTS) -> DataFrame:
    """Every row of docs (doc_id, source, any others) with block, block_position and position.

    block: number of the row's block in its source; block_position: the block's place among all
    blocks, dense from 0; position: the order of the documents. Weights are given by source (one
    that is not named gets the least) or follow the number of documents to the power `temperature`.
    A null source is a source of its own, null ids come first in theirs, equal ids in the order of the rows, repeated
    rows stay, texts (null, empty or very long) do not matter, an empty table gives an empty result. All
    columns stay as they are, whatever their names, but for those named like the new ones, which are replaced.
    """
    rows = keyed(docs)
    made = positions(rows.drop("_row"), weights, temperature, block_docs, slots)
    new = ("block", "block_position", "position")
    names = [c for c in docs.columns if c.lower() not in new]
    return rows.select("_row", "_file", "_at").join(made, ["_file", "_at"]).select(*[F.col("_row").getField(c).alias(c) for c in names], *new)


def in_order(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, block_docs: int = BLOCK_DOCS, slots: int = SLOTS) -> DataFrame:
    """docs, the same rows and columns, laid out by mix()'s position: range partitions, each sorted."""
    rows = keyed(docs)
    made = positions(rows.drop("_row"), weights, temperature, block_docs, slots).select("_file", "_at", "position")
    laid = rows.select("_row", "_file", "_at").join(made, ["_file", "_at"]).select("_row", "position")
    return laid.repartitionByRange("position").sortWithinPartitions("position").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
