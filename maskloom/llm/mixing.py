"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Documents of a source stand in the order of a hash of their ids and are cut into blocks of
``block_docs``. A source that holds ``share`` of the ``period`` time slots gives its block ``b``
(from 0) the release ``floor(b * period / share)`` and the deadline ``ceil((b + 1) * period /
share)``. In each slot the released block with the earliest deadline is placed; ties go to the first
source by name. That places every block within its window, so after any number of slots every source
has had its weight's share of them to within less than one block. The schedule of one period is
computed once (three numbers for each slot) and repeats; a block's slot follows by arithmetic, and its
position by sums over ranges of slots.

The period holds 1,000 slots; with more than a sixteenth as many sources it grows to 16 slots a source,
and shares are rounded cumulatively, so that they add up to it and the target of no source drifts by more
than a slot a period. Sources of less than one slot have one.

Nothing is dropped: where a source has run out, its slots are passed over, and the others keep their
proportions to each other. ``position`` numbers all documents from 0 without gaps.

Edge cases: a NULL source is a source of its own; a source without a target has one slot of a period;
targets without documents hold none; repeated rows are mixed as often as they stand there; an empty
table gives no rows; columns that are called like new ones are replaced in ``schedule`` and kept in
``mixed``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.llm.common import free_name, stored

#: Slots of a period before rounding; weights are kept to about a thousandth.
PERIOD = 1000
#: Slots of a period for each source, at least.
SLOTS_EACH = 16
#: Slots that are scheduled together: only as many of the waiting blocks can be placed in them.
STRETCH = 128
#: Slots whose documents are summed before positions run on.
RANGE = 1024
BLOCK_DOCS = 8
#: Hex digits of the hash by which a source's rows are numbered in parts: 4096 parts.
PART_DIGITS = 3


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def shares(docs: DataFrame, targets: Mapping[str | None, float] | None = None, period: int = PERIOD) -> DataFrame:
    """One row: ``sources``, an array of ``key, n, share`` by key, and ``slots``, the sum of the shares.

    Without ``targets`` a source's weight is the square root of its number of documents.
    """
    sizes = docs.groupBy(_key().alias("key")).agg(F.count("*").alias("n"))
    if targets is None:
        weight = F.sqrt("n")
    else:
        entries = [F.lit(x) for s, w in targets.items() for x in ("" if s is None else f"={s}", float(w))]
        weight = F.coalesce(F.try_element_at(F.create_map(*entries), F.col("key")), F.lit(0.0)) if entries else F.lit(0.0)
    sizes = sizes.select("key", "n", weight.alias("weight"))
    sizes = sizes.withColumn("up_to", F.sum("weight").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
    gathered = sizes.agg(F.sort_array(F.collect_list(F.struct("key", "n", "weight", "up_to"))).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["weight"])
    many = F.size("all") * SLOTS_EACH > period
    wide = F.greatest(F.size("all") * SLOTS_EACH, F.lit(period))

    def share(x: Column) -> Column:
        slots = lambda w: F.round(F.col("wide") * w / F.nullif(F.col("total"), F.lit(0.0)))
        rounded = F.when(F.col("many"), slots(x["up_to"]) - slots(x["up_to"] - x["weight"])).otherwise(slots(x["weight"]))
        return F.greatest(F.lit(1), F.coalesce(rounded, F.lit(1)).cast("long"))

    return gathered.select("all", total.alias("total"), many.alias("many"), wide.alias("wide")).select(
        F.transform("all", lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n"), share(x).alias("share"))).alias("sources")
    ).select("sources", F.aggregate("sources", F.lit(0).cast("long"), lambda a, x: a + x["share"]).alias("slots"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def period_schedule(plan: DataFrame) -> DataFrame:
    """``slot, turn, nth`` for each slot of a period: the source (its place in ``sources``), and how many
    blocks it has had in the period.

    Blocks wait in the order of their deadlines. A stretch of slots can only place as many of them, so
    the others are left aside until its end: a slot costs a sort of two stretches at most, whatever the
    number of sources.
    """
    sources = plan.select("slots", F.posexplode("sources").alias("turn", "s"))
    jobs = sources.select("slots", "turn", "s.share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s.share") - 1)).alias("nth"))
    ends = F.ceil((F.col("nth") + 1) * F.col("slots") / F.col("share"))
    jobs = jobs.select(F.floor(F.col("nth") * F.col("slots") / F.col("share")).alias("t"), F.struct(ends.alias("deadline"), "turn", "nth").alias("job"))
    slots = plan.filter("slots > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("t"))
    slots = slots.select("t", F.lit(None).cast(jobs.schema["job"].dataType).alias("job")).unionByName(jobs)
    slots = slots.groupBy("t").agg(F.sort_array(F.collect_list("job")).alias("jobs"))
    stretches = slots.groupBy(F.floor(F.col("t") / STRETCH).alias("at")).agg(F.sort_array(F.collect_list(F.struct("t", "jobs"))).alias("slots"))
    row = stretches.agg(F.sort_array(F.collect_list(F.struct("at", "slots"))).alias("stretches"))

    none = F.array().cast(slots.schema["jobs"].dataType)

    def place(state: Column, slot: Column) -> Column:
        def first(waiting: Column) -> Column:
            return F.struct(
                F.slice(waiting, 2, F.size(waiting)).alias("waiting"),
                F.concat(state["out"], F.slice(waiting, 1, 1)).alias("out"),
            )

        return _let(F.sort_array(F.concat(state["waiting"], slot["jobs"])), first)

    def stretch(state: Column, x: Column) -> Column:
        near = F.struct(F.slice(state["waiting"], 1, STRETCH).alias("waiting"), none.alias("out"))
        aside = F.slice(state["waiting"], STRETCH + 1, F.size(state["waiting"]) + 1)
        return _let(
            F.aggregate(x["slots"], near, place),
            lambda done: F.struct(
                F.sort_array(F.concat(done["waiting"], aside)).alias("waiting"),
                F.concat(state["out"], done["out"]).alias("out"),
            ),
        )

    start = F.struct(none.alias("waiting"), none.alias("out"))
    placed = row.select(F.posexplode(F.aggregate("stretches", start, stretch)["out"]).alias("slot", "x"))
    return placed.select("slot", F.col("x.turn").alias("turn"), F.col("x.nth").alias("nth"))


def schedule(
    docs: DataFrame,
    targets: Mapping[str | None, float] | None = None,
    block_docs: int = BLOCK_DOCS,
    period: int = PERIOD,
) -> DataFrame:
    """``docs`` with ``block, release, deadline, slot, position``."""
    new = ["block", "release", "deadline", "slot", "position"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    hidden = {name: free_name(docs, f"mix_{name}") for name in ("hash", "part", "tie", "key", "row", "k", "p", "earlier", "share", "slots", "spots")}
    h = hidden.__getitem__
    plan = shares(docs, targets, period)
    rows = docs.withColumns({
        h("key"): _key(),
        h("hash"): F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
        h("tie"): F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]),
    }).withColumn(h("part"), F.substring(h("hash"), 1, PART_DIGITS))
    # Numbered in parts: a source with a third of all rows is spread over thousands of windows.
    parts = rows.groupBy(F.col(h("key")).alias("key"), F.col(h("part")).alias("part")).agg(F.count("*").alias("of_part"))
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("earlier", F.coalesce(F.sum("of_part").over(ahead), F.lit(0)))
    spots = _spots(parts, plan, block_docs).select(*[F.col(c).alias(h(c[0] if c in ("key", "part") else c)) for c in ("key", "part", "earlier", "share", "slots", "spots")])
    within = Window.partitionBy(h("key"), h("part")).orderBy(h("hash"), "doc_id", h("tie"))
    numbered = rows.withColumn(h("row"), F.row_number().over(within) - 1)
    # Rows keep the partitions of their numbering.
    placed = numbered.join(spots, (F.col(h("key")) == F.col(h("k"))) & (F.col(h("part")) == F.col(h("p"))))
    row = F.col(h("row")) + F.col(h("earlier"))
    block, share, slots = F.floor(row / block_docs), F.col(h("share")), F.col(h("slots"))
    spot = F.get(h("spots"), (block - F.floor(F.col(h("earlier")) / block_docs)).cast("int"))
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        block.alias("block"),
        F.floor(block * slots / share).alias("release"),
        F.ceil((block + 1) * slots / share).alias("deadline"),
        spot["slot"].alias("slot"),
        (spot["start"] + row % block_docs).alias("position"),
    )


def _spots(parts: DataFrame, plan: DataFrame, block_docs: int) -> DataFrame:
    """``key, part, earlier, share, slots, spots``: for each part of a source, the slots of the blocks
    that it holds documents of, and the positions at which they start, by block.

    A row for each block of a part, without texts, is stored when this is called. The documents of a range of slots are summed first, so
    positions run over ranges and then within each.
    """
    each = plan.select("slots", F.posexplode("sources").alias("turn", "s")).select("slots", "turn", F.col("s.key").alias("key"), "s.n", "s.share")
    first, last = F.floor(F.col("earlier") / block_docs), F.floor((F.col("earlier") + F.col("of_part") - 1) / block_docs)
    # One row for each source.
    blocks = parts.join(F.broadcast(each), "key").select("*", F.explode(F.sequence(first, last)).alias("block"))
    blocks = blocks.withColumn("nth", F.col("block") % F.col("share"))
    blocks = blocks.join(period_schedule(plan).withColumnRenamed("slot", "of_period"), ["turn", "nth"])
    # A block that parts share counts where it starts.
    docs_of = F.when(F.col("block") * block_docs >= F.col("earlier"), F.least(F.lit(block_docs), F.col("n") - F.col("block") * block_docs)).otherwise(0)
    blocks = blocks.select(
        "key", "part", "earlier", "share", "slots", "block", docs_of.cast("long").alias("docs"),
        (F.floor(F.col("block") / F.col("share")) * F.col("slots") + F.col("of_period")).alias("slot"),
    ).withColumn("range", F.floor(F.col("slot") / RANGE))
    # Stored, as it is read twice.
    blocks = stored(blocks, "mix_blocks")
    ranges = blocks.groupBy(F.col("range").alias("r")).agg(F.sum("docs").alias("in_range"))
    ahead = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("r", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)).alias("base"))
    before = F.sum("docs").over(Window.partitionBy("range").orderBy("slot").rangeBetween(Window.unboundedPreceding, -1))
    started = blocks.withColumn("before", F.coalesce(before, F.lit(0))).join(ranges, F.col("range") == F.col("r"))
    spot = F.struct("block", (F.col("base") + F.col("before")).alias("start"), "slot")
    return started.groupBy("key", "part").agg(
        *[F.first(c).alias(c) for c in ("earlier", "share", "slots")], F.sort_array(F.collect_list(spot)).alias("spots")
    )


def positioned(docs: DataFrame, name: str, targets: Mapping[str | None, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows and columns of ``docs``, and the position as ``name``, which ``docs`` must not have."""
    taken = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in ("block", "release", "deadline", "slot", "position")}
    placed = schedule(docs.withColumnsRenamed(taken), targets, block_docs)
    return placed.select(*[F.col(f"`{taken.get(c, c)}`").alias(c) for c in docs.columns], F.col("position").alias(name))


def mixed(docs: DataFrame, targets: Mapping[str | None, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows and columns of ``docs`` in mixed order: partitions follow each other by position.

    A reader of stored files need not keep that order; ``positioned`` gives the same one as a column."""
    name = free_name(docs, "mix_at")
    in_order = positioned(docs, name, targets, block_docs).repartitionByRange(name).sortWithinPartitions(name)
    return in_order.select(*[F.col(f"`{c}`") for c in docs.columns])
