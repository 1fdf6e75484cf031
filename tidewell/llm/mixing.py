"""Mixing sources to target weights by pivotal dependent rounding.

Every document is due a fractional number of copies, target / size of its source. The whole part is taken
as it is; the fractions are rounded in pairs: mass (fraction times size) moves at random from one
document to the other, with the expected value of both kept, until one of them is integral. What is left
over from a block of documents meets the leftovers of other blocks in a tree, up to one per source.

Documents are rounded from the large to the small, in TIERS of size. A coin decides the last one of a tier; what it adds or
takes is spread over the copies that all smaller documents of the source are due, so that the words it takes differ from its
target by one of its smallest documents. A coin's expected value is 0, so that every document keeps its expected copies.
Where the smaller documents together have too few words for that, less is spread, as much as keeps their copies within 0
and max_repeat whichever way the coin falls, and the source stays off by the rest.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own,
the last one; rows alike in id, source and text are one unit and share its decision; an empty table gives
an empty result; further columns are kept by ``mix`` and may have any name but those starting with ``__mix_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored, uniform

#: Runs of anything but ASCII white space.
GAP = r"[\x20\x09-\x0D]+"
FAN_IN = 64
#: Least sizes of the tiers, as parts of the mean size of a source's documents; the last tier has the rest.
TIERS = (4.0, 2.0, 1.0, 0.5, 0.25, 0.0625)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null counts as none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (1, 2, 3), max_repeat: float = 3.0) -> DataFrame:
    """sizes: (source, source_size, ...), a row for each source. Adds target: shares of the total by weight, weights
    repeating over the sources by code point with null last, stopped at max_repeat times the source's size,
    the excess reshared by weight. The table has a row for each source, so that its windows stay small.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    t = sizes.withColumn("__rank", rank).withColumn("__w", F.element_at(cycle, ((F.col("__rank") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("__cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("__left", F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
    t = t.withColumn("__wleft", F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    t = t.withColumn("__level", F.col("__left") / F.col("__wleft"))
    t = t.withColumn("__first", F.when(F.col("__cap") / F.col("__w") >= F.col("__level"), F.struct(F.row_number().over(by_level), "__level")))
    level = F.min("__first").over(everything)["__level"]
    return t.withColumn("target", F.least(F.col("__cap"), F.coalesce(level, F.lit(0.0)) * F.col("__w"))).drop("__rank", "__w", "__cap", "__left", "__wleft", "__level", "__first")


def _rounded(block: Column, seed: int, level: int) -> Column:
    """Round the units of one block in turn: struct of the resolved units and of the one left over."""
    empty = F.array().cast("array<struct<id:struct<doc:string,key:bigint>,extra:int>>")
    start = F.struct(F.lit(None).cast("struct<doc:string,key:bigint>").alias("id"), F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(False).alias("live"), empty.alias("done"))

    def state(id_, a, x, live, done):
        return F.struct(id_.alias("id"), a.alias("a"), x.alias("x"), live.alias("live"), done.alias("done"))

    def resolved(id_, x):
        return F.struct(id_.alias("id"), F.round(x).cast("int").alias("extra"))

    def whole(x):
        return (x <= 1e-12) | (x >= 1 - 1e-12)

    def pair(c, d):
        room = let(
            F.struct(
                (c.a * (1 - c.x)).alias("c_up"), (d.a * d.x).alias("d_down"), (c.a * c.x).alias("c_down"), (d.a * (1 - d.x)).alias("d_up"),
                uniform(F.lit(seed), F.lit(level), c.id.key, d.id.key).alias("u"),
            ),
            lambda r: let(
                F.struct(F.least(r.c_up, r.d_down).alias("up"), F.least(r.c_down, r.d_up).alias("down"), r.alias("r")),
                lambda m: F.when(
                    m.r.u * (m.up + m.down) < m.down,
                    F.struct(
                        F.when(m.r.c_up <= m.r.d_down, 1.0).otherwise(c.x + m.up / c.a).alias("cx"),
                        F.when(m.r.d_down <= m.r.c_up, 0.0).otherwise(d.x - m.up / d.a).alias("dx"),
                    ),
                ).otherwise(
                    F.struct(
                        F.when(m.r.c_down <= m.r.d_up, 0.0).otherwise(c.x - m.down / c.a).alias("cx"),
                        F.when(m.r.d_up <= m.r.c_down, 1.0).otherwise(d.x + m.down / d.a).alias("dx"),
                    )
                ),
            ),
        )
        return let(
            room,
            lambda y: F.when(
                whole(y.cx) & whole(y.dx),
                state(c.id, F.lit(0.0), F.lit(0.0), F.lit(False), F.concat(c.done, F.array(resolved(c.id, y.cx), resolved(d.id, y.dx)))),
            )
            .when(whole(y.cx), state(d.id, d.a, y.dx, F.lit(True), F.concat(c.done, F.array(resolved(c.id, y.cx)))))
            .otherwise(state(c.id, c.a, y.cx, F.lit(True), F.concat(c.done, F.array(resolved(d.id, y.dx))))),
        )

    return F.aggregate(block, start, lambda c, d: F.when(c.live, pair(c, d)).otherwise(state(d.id, d.a, d.x, F.lit(True), c.done)))


def _tree(live: DataFrame, most: int, seed: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Round the fractions x of all units, block by block and level by level: (id, extra) of those resolved on the
    way, and (source, id, a, x, extra) of the one left in each source, which its own chance decides."""
    levels = 1 + max(0, math.ceil(math.log(most, FAN_IN) - 1e-9)) if most > 1 else 1
    done = None
    for level in range(levels):
        entry = F.struct(F.xxhash64(F.lit(seed + 1), "id").alias("order"), "id", "a", "x")
        merged = live.groupBy("source", "block").agg(_rounded(F.sort_array(F.collect_list(entry)), seed, level).alias("s"))
        merged = stored(merged, f"mix-{name}{level}")
        found = merged.select(F.explode("s.done").alias("d")).select("d.id", "d.extra")
        live = merged.where("s.live").select("source", "s.id", "s.a", "s.x", F.floor(F.col("block") / FAN_IN).cast("long").alias("block"))
        done = found if done is None else done.unionByName(found)
    return done, live.drop("block").withColumn("extra", (uniform(F.lit(seed + 2), "id") < F.col("x")).cast("int"))


def copies(units: DataFrame, targets: DataFrame, seed: int = 17, max_repeat: float = 3.0) -> DataFrame:
    """units: (doc string, key long, source, unit_size long, n long); targets: (source, source_size, target, units).
    Returns units with source_size, target and copies int. Blocks hold about FAN_IN units each, by hash, whatever
    a source's share of all units; level by level FAN_IN blocks meet, until a source has one.

    The tiers come one after the other, each with the copies that the coins of those before have left it. The tables of
    a row for each source and tier are joined as Spark sees fit by their size.
    """
    t = targets.select(F.col("source").alias("__source"), "source_size", "target", (F.col("source_size") / F.col("units")).alias("__mean"))
    placed = units.join(t, units.source.eqNullSafe(t["__source"])).drop("__source")
    tier = F.lit(len(TIERS))
    for i in reversed(range(len(TIERS))):
        tier = F.when(F.col("unit_size") > TIERS[i] * F.col("__mean"), i).otherwise(tier)
    placed = placed.withColumn("__tier", tier).drop("__mean")
    live = placed.where("unit_size > 0").select("source", F.struct("doc", "key").alias("id"), F.col("unit_size").cast("double").alias("a"), F.xxhash64(F.lit(seed), "doc", "key").alias("hash"), "__tier", (F.col("target") / F.col("source_size")).alias("ratio"))
    live = stored(live, "mix-live")
    of = live.groupBy(F.col("source").alias("__of"), F.col("__tier").alias("__at")).agg(F.sum("a").alias("__mass"), F.max("ratio").alias("__due"), F.ceil(F.count("*") / FAN_IN).alias("__blocks"))
    below = F.sum("__mass").over(Window.partitionBy("__of").orderBy("__at").rowsBetween(1, Window.unboundedFollowing))
    of = stored(of.withColumn("__below", F.coalesce(below, F.lit(0.0))), "mix-tiers")
    done, due, shift = None, None, None  # shift: by how much the coins so far lower what smaller documents are due, by source
    for i, most in of.groupBy("__at").agg(F.max("__blocks")).orderBy("__at").collect():
        mine = of.where(F.col("__at") == i)
        if shift is not None:
            mine = mine.join(shift, F.col("__of").eqNullSafe(F.col("__from")), "left").withColumn("__due", F.greatest(F.lit(0.0), F.col("__due") - F.coalesce("__shift", F.lit(0.0)))).drop("__from", "__shift")
        mine = stored(mine, "mix-due")
        own = live.where(F.col("__tier") == i).drop("ratio").join(mine, F.col("source").eqNullSafe(F.col("__of")))
        own = own.withColumn("x", F.col("__due") - F.floor("__due")).where((F.col("x") > 1e-12) & (F.col("x") < 1 - 1e-12))
        resolved, last = _tree(own.select("source", "id", "a", "x", F.pmod("hash", "__blocks").alias("block")), most, seed + 5 * i, f"tier{i}-")
        last = stored(last, "mix-last")
        for more in (resolved, last.select("id", "extra")):
            done = more if done is None else done.unionByName(more)
        due = mine if due is None else due.unionByName(mine)
        coin = last.select(F.col("source").alias("__from"), "a", "x", "extra").join(mine.where("__below > 0"), F.col("__from").eqNullSafe(F.col("__of")))
        took, left = F.col("a") * (1 - F.col("x")) / F.col("__below"), F.col("a") * F.col("x") / F.col("__below")
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("__due"), took), F.try_divide(F.lit(float(max_repeat)) - F.col("__due"), left)))
        coin = coin.select("__from", (part * F.when(F.col("extra") == 1, took).otherwise(-left)).alias("__shift"))
        shift = stored(coin if shift is None else shift.unionByName(coin).groupBy("__from").agg(F.sum("__shift").alias("__shift")), "mix-shift")
    if done is None:
        return placed.withColumn("copies", F.lit(0)).drop("__tier")
    done = done.select(F.col("id.doc").alias("__doc"), F.col("id.key").alias("__key"), "extra")
    out = placed.join(due.select("__of", "__at", "__due"), placed.source.eqNullSafe(F.col("__of")) & (F.col("__tier") == F.col("__at")), "left")
    out = out.join(done, placed.doc.eqNullSafe(done["__doc"]) & (placed.key == done["__key"]), "left")
    whole = F.floor(F.col("__due") + 1e-12).cast("int")
    taken = F.when(F.col("unit_size") > 0, whole + F.coalesce("extra", F.lit(0))).otherwise(F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int"))
    return out.withColumn("copies", taken).drop("__doc", "__key", "extra", "__of", "__at", "__due", "__tier")


def plan(docs: DataFrame, weights: tuple = (1, 2, 3), max_repeat: float = 3.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row for each unit (rows alike in id, source and text): doc, key, source, size, n, source_size, target, copies."""
    unit_key = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))
    rows = docs.select(F.col(id_col).cast("string").alias("doc"), unit_key.alias("key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    units = stored(rows.groupBy("doc", "key", "source").agg(F.max("size").alias("size"), F.count("*").alias("n")).withColumn("unit_size", F.col("size") * F.col("n")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum("unit_size").alias("source_size"), F.count("*").alias("units"))
    targets = stored(source_targets(sizes, weights, max_repeat), "mix-targets")
    return copies(units, targets, seed, max_repeat)


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (0 times: left out); all columns are kept."""
    id_col, source_col, text_col = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text")))
    p = plan(docs, **options).select(F.col("doc").alias("__mix_doc"), F.col("key").alias("__mix_key"), F.col("copies").alias("__mix_copies")).where("__mix_copies > 0")
    keyed = docs.withColumn("__mix_k", F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))).withColumn("__mix_d", F.col(id_col).cast("string"))
    out = keyed.join(p, (F.col("__mix_k") == F.col("__mix_key")) & F.col("__mix_d").eqNullSafe(F.col("__mix_doc")))
    return out.withColumn("__mix_i", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
