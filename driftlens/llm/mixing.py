"""Mixing sources to target weights by Pfair scheduling (op 4); DataFrame operations only.

Documents of a source are put into units of a third of ``block_docs`` in a seeded pseudo-random order, and every slot of the mix holds one unit. Time is cut
into periods of a power of two slots that are scheduled each by itself, in parallel:

- *Between periods* a source with weight w has had floor or ceil of w t units at slot t: the sources stand in a row, and with c_k the sum of the
  weights up to the k-th, source k has had floor(c_k t) - floor(c_(k-1) t). Nothing is rounded to the period, so nothing drifts.
- *Within a period* of P slots the source's n units are Pfair: unit j is released at slot floor(j P / n) and due at ceil((j + 1) P / n),
  and each slot takes the released unit of the earliest deadline (ties: smaller rank). The n add up to P, so all deadlines are met.

Both errors are less than one unit, so at any slot a source is less than two units, that is, less than one block of ``block_docs`` documents (of 3 at least), away
from its target. Sources with less than two units a period share a pool, which is scheduled as one source; in the pool they are scheduled among
themselves in the same manner, over ``LEVELS`` levels. Weights are whole parts of ``UNIT``, one at least: an error of slots / UNIT units.

When a source has run out its slots stay empty and the others go on: every document comes out exactly once. Beyond ``FAR`` times as many slots as there are
units, where hardly a source is left, a unit goes to the slot of its release, i / w. Without ``targets`` the weights are
the sources' document counts to the power ``temper``.

Defined results: a null source is a source of its own; sources that targets do not name, or name with a weight of
zero or less, come after all others, in the same manner among themselves; repeated rows each get a place; columns named as those that are added are
replaced; a table without rows gives none.

Scale: rows are numbered within (source, slice of the order), a slice being one of ``SLICES`` ranges of a hash, and moved up by the
counts of the slices before; a source with a third of all rows is spread over all slices. Only ids move, not texts,
unless texts are asked for in order. Plan and slices meet by (source, unit), of which each has a row; rows take their slots from their slice's, where they
are already. Tables of sources, a row each, are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlens.llm.common import written

PERIOD, CHUNK = 4096, 64  # slots; slots that the schedule puts together at once
BLOCK_DOCS = 16
TEMPER = 0.7
UNIT = 1 << 36
LEVELS = 4
FAR = 4
SLICES = 1024  # of the order of each source; a power of 16
POOL = 2**31 - 1
_COLUMNS = ("mix_tier", "mix_slot", "mix_at")
_div = lambda a, b: F.call_function("div", a, b)
_long = lambda x: F.lit(x).cast("long")


def weighed(sizes: DataFrame, targets: dict[str, float] | None, temper: float, unit: int) -> DataFrame:
    """sizes (source, n) -> source, tier (0: to be mixed, 1: after all others), rank, units, w, level. A row a source."""
    if targets is None:
        w = F.pow(F.col("n").cast("double"), F.lit(temper))
    else:
        given = F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, float(v))]) if targets else F.create_map().cast("map<string,double>")
        w = F.coalesce(given[F.coalesce(F.col("source"), F.lit(""))], F.lit(0.0))
    of_tier = Window.partitionBy("tier")
    out = sizes.withColumn("w", w).withColumn("tier", F.when(F.col("w") > 0, 0).otherwise(1)).withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(F.col("n").cast("double")))
    out = out.withColumn("w", F.greatest("w", F.sum("w").over(of_tier) / UNIT)).withColumn("rank", F.row_number().over(of_tier.orderBy(F.col("source").asc_nulls_first())))
    out = out.withColumns({"units": _div(F.col("n") + (unit - 1), _long(unit)), "level": F.lit(LEVELS)})
    # from the last level up: what has two units a period among the sources that no level above has taken
    for level in range(1, LEVELS):
        left = F.col("level") == LEVELS
        all_w, all_n = F.sum(F.when(left, F.col("w"))).over(of_tier), F.count(F.when(left, 1)).over(of_tier)
        out = out.withColumn("level", F.when(left & (F.col("w") * _period(all_n) >= 2 * all_w), level).otherwise(F.col("level")))
    return out.select("source", "tier", "rank", "units", "w", "level")


def _period(sources: Column) -> Column:
    """Slots of a period: a power of two, 32 a source at least."""
    return F.greatest(_long(PERIOD), F.pow(F.lit(2.0), F.ceil(F.log2(sources * 32))).cast("long"))


def items(sources: DataFrame) -> DataFrame:
    """sources as weighed() gives them -> tier, level, period, periods, s: the items of a level in a row, each with rank, lo and hi, its place among UNIT parts."""
    at = sources.select("tier", "rank", "w", "units", F.col("level").alias("own"), F.explode(F.sequence(F.lit(1), F.col("level"))).alias("level"))
    of_level = Window.partitionBy("tier", "level")
    # what the slowest source needs, were it alone in its levels
    at = at.withColumn("need", F.ceil((F.col("units") + 4) * (F.sum("w").over(of_level) / F.col("w"))).cast("long"))
    item = F.when(F.col("own") == F.col("level"), F.col("rank")).otherwise(POOL).alias("rank")
    each = at.groupBy("tier", "level", item).agg(F.sum("w").alias("w"), F.sum("units").alias("units"), F.max("need").alias("need"))
    order = of_level.orderBy("rank")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, number = F.count("*").over(of_level), F.row_number().over(order)
    # one part each, the others by the rounded running sum, so that nothing is left over
    cut = F.round(F.sum("w").over(upto) / F.sum("w").over(of_level) * (_long(UNIT) - n)).cast("long")
    each = each.withColumn("hi", F.when(number == n, _long(UNIT)).otherwise(cut + number)).withColumn("n", n)
    each = each.withColumn("lo", F.coalesce(F.lag("hi").over(order), _long(0)))
    period = F.max(_period(F.col("n")))
    far = F.least(F.max("need"), FAR * F.sum("units") + FAR * period)
    return each.groupBy("tier", "level").agg(period.alias("period"), (_div(far - 1, period) + 1).alias("periods"), F.array_sort(F.collect_list(F.struct("rank", "lo", "hi"))).alias("s"))


def plan(of_levels: DataFrame) -> DataFrame:
    """items() -> tier, level, rank, i, slot of each unit of each item: an earliest-deadline-first schedule of every period."""
    spark = of_levels.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = of_levels.select("tier", "level", "period", "s", F.explode(F.sequence(_long(0), F.col("periods") - 1)).alias("p")).repartition(tasks, "tier", "level", "p")
    part = _div(_long(UNIT), F.col("period"))
    upto = lambda c, p: _div(c * p, part)
    had = lambda x, p: upto(x["hi"], p) - upto(x["lo"], p)
    each = F.transform("s", lambda x: F.struct(_long(0).alias("had"), (had(x, F.col("p") + 1) - had(x, F.col("p"))).alias("n")))
    none = _long(2**62)

    def step(state: Column, t: Column) -> Column:
        p = state["p"]
        options = F.transform(
            state["all"],
            lambda x, i: F.struct(F.when((x["had"] < x["n"]) & (x["had"] * p < (t + 1) * x["n"]), _div((x["had"] + 1) * p + x["n"] - 1, x["n"])).otherwise(none).alias("due"), i.cast("int").alias("i"), x["had"].alias("had")),
        )
        chosen = F.array_min(options)
        # bound once
        return F.aggregate(
            F.array(chosen),
            state,
            lambda s, c: F.struct(
                F.transform(s["all"], lambda x, i: F.struct(F.when(i == c["i"], x["had"] + 1).otherwise(x["had"]).alias("had"), x["n"].alias("n"))).alias("all"),
                s["p"].alias("p"),
                F.concat(s["plan"], F.array(F.struct(c["i"].alias("i"), c["had"].alias("had")))).alias("plan"),
            ),
        )

    nothing = "array<struct<i:int,had:bigint>>"

    def chunk(state: Column, c: Column) -> Column:
        start = F.struct(state["all"].alias("all"), state["p"].alias("p"), F.array().cast(nothing).alias("plan"))
        done = F.aggregate(F.sequence(c * CHUNK, c * CHUNK + CHUNK - 1), start, step)
        return F.aggregate(F.array(done), state, lambda s, d: F.struct(d["all"].alias("all"), d["p"].alias("p"), F.concat(s["plans"], F.array(d["plan"])).alias("plans")))

    start = F.struct(each.alias("all"), F.col("period").alias("p"), F.array().cast(f"array<{nothing}>").alias("plans"))
    chunks = F.sequence(_long(0), _div(F.col("period"), _long(CHUNK)) - 1)
    flat = rows.select("tier", "level", "period", "p", "s", F.posexplode(F.flatten(F.aggregate(chunks, start, chunk)["plans"])).alias("at", "x"))
    item = F.col("s")[F.col("x.i")]
    return flat.select("tier", "level", item["rank"].alias("rank"), (had(item, F.col("p")) + F.col("x.had")).alias("i"), (F.col("p") * F.col("period") + F.col("at")).alias("slot"))


def unit_slots(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tier, rank, i, slot of the units that the schedule reaches; tier, far: the slots that it spans)."""
    of_levels = items(sources)
    depth = sources.agg(F.max("level")).first()[0] or 1
    found = plan(of_levels)
    if depth > 1:
        found = written(found, "plan")
    slots = None
    for level in range(depth, 0, -1):
        here = found.where(F.col("level") == level).select("tier", "rank", "i", "slot")
        own = here.where(F.col("rank") != POOL)
        if slots is None:
            slots = own
            continue
        pool = here.where(F.col("rank") == POOL).select("tier", F.col("i").alias("slot"), F.col("slot").alias("above"))
        last = F.element_at("s", -1)
        share = of_levels.where(F.col("level") == level).select("tier", (F.col("period") * F.col("periods")).alias("far"), ((last["hi"] - last["lo"]) / UNIT).alias("share"))
        release = F.greatest("far", F.floor(F.col("slot") / F.col("share")))
        slots = own.union(slots.join(pool, ["tier", "slot"], "left").join(share, "tier").select("tier", "rank", "i", F.coalesce("above", release).alias("slot")))
    return slots, of_levels.where("level = 1").select("tier", (F.col("period") * F.col("periods")).alias("far"))


def placed(docs: DataFrame, targets: dict[str, float] | None = None, *, source: str = "source", key: str = "doc_id", seed: str = "mix", block_docs: int = BLOCK_DOCS, temper: float = TEMPER) -> DataFrame:
    """docs with the columns mix_tier, mix_slot, mix_at: its place is their order; a slot holds one unit of one source."""
    unit = max(1, block_docs // 3)
    # all names of its own begin with __mix_; a source without nulls, so that rows need no second shuffle to meet their slots
    s, h, cut = "__mix_source", "__mix_hash", "__mix_slice"
    named = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))
    base = docs.withColumn(s, named).withColumn(h, F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")))
    digits = len(f"{SLICES - 1:x}")
    base = base.withColumn(cut, F.floor(F.conv(F.substring(h, 1, digits), 16, 10).cast("int") / F.lit(16**digits // SLICES)).cast("int"))
    counts = written(base.groupBy(s, cut).agg(F.count("*").alias("n")), "counts")
    real = F.when(F.col(s) != "", F.expr(f"substring({s}, 2)"))
    sources = written(weighed(counts.groupBy(s).agg(F.sum("n").alias("n")).select(real.alias("source"), "n"), targets, temper, unit), "sources")
    slots, far = unit_slots(sources)
    # units of each slice, and the slots of these; a slice is a 1024th of a source
    upto = Window.partitionBy(s).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    share = F.col("w") / F.sum("w").over(Window.partitionBy("tier"))
    known = sources.withColumn("share", share).join(far, "tier").select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias(s), "tier", "rank", "share", "far")
    before = counts.select(s, cut, "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")).join(known, s)
    lo, hi = _div(F.col("before"), _long(unit)), _div(F.col("before") + F.col("n") - 1, _long(unit))
    own = before.select(s, cut, "tier", "rank", "share", "far", "before", lo.alias("lo"), F.explode(F.sequence(lo, hi)).alias("i"))
    slot = F.coalesce("slot", F.greatest("far", F.floor(F.col("i") / F.col("share"))))
    # the plan grows with the corpus, whatever its compressed size: it is never broadcast
    found = own.join(slots.hint("merge"), ["tier", "rank", "i"], "left").groupBy(s, cut).agg(F.first("tier").alias("__mix_tier"), F.first("before").alias("__mix_before"), F.first("lo").alias("__mix_lo"), F.array_sort(F.collect_list(F.struct("i", slot.alias("slot")))).alias("__mix_slots"))
    numbered = base.withColumn("__mix_nth", F.row_number().over(Window.partitionBy(s, cut).orderBy(h, key)) - 1)
    at = numbered.join(found, [s, cut]).withColumn("__mix_i", F.col("__mix_before") + F.col("__mix_nth"))
    mine = F.get("__mix_slots", (_div(F.col("__mix_i"), _long(unit)) - F.col("__mix_lo")).cast("int"))
    kept = [F.col(c) for c in docs.columns if c.lower() not in _COLUMNS]
    return at.select(*kept, F.col("__mix_tier").alias("mix_tier"), mine["slot"].alias("mix_slot"), F.pmod("__mix_i", _long(unit)).cast("int").alias("mix_at"))


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, *, source: str = "source", **how) -> DataFrame:
    """docs in the order of the mix, over all files that are written from it; the same columns and rows."""
    order = ["__tier", "__slot", "__of", "__at"]
    kept = docs.columns
    # under other names while they are placed, so that none is replaced
    held = docs.withColumns({f"__{c}_held": F.col(c) for c in kept if c.lower() in _COLUMNS})
    at = placed(held, targets, source=source, **how).withColumnsRenamed({"mix_tier": "__tier", "mix_slot": "__slot", "mix_at": "__at"}).withColumn("__of", F.col(source).cast("string"))
    at = at.withColumnsRenamed({f"__{c}_held": c for c in kept if c.lower() in _COLUMNS})
    return at.repartitionByRange(*order).sortWithinPartitions(*order).select(*kept)
