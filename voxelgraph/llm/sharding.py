"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` positions. Every shard owns ``vnodes`` of them; a row's hashed key falls on a cell
and belongs to the next virtual node clockwise. A shard takes rows up to its capacity; what overflows
continues clockwise to the next virtual node whose shard has room.

The corpus is never sorted as a whole and never collected: rows are counted per cell, the walk round the
ring runs on that histogram (``cells`` and ``shards * vnodes`` are parameters, so its size does not grow
with the data), and the rows then look up where their rank within their cell was sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelgraph.session import staged, table

#: Positions on the ring; at 10^11 rows one cell still holds only about 1.5 million.
CELLS = 1 << 16


def ring(spark: SparkSession, shards: int, vnodes: int, cells: int = CELLS) -> DataFrame:
    """``(cell, arc, shard)`` for each cell; ``arc`` is the cell of the virtual node that owns it.

    Two virtual nodes on one cell: the smaller shard has it.
    """
    nodes = (
        spark.range(0, shards * vnodes, 1, 1)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("replica"))
        .select("shard", F.pmod(F.xxhash64(F.lit("virtual node"), "shard", "replica"), F.lit(cells)).alias("cell"))
        .groupBy("cell")
        .agg(F.min("shard").alias("shard"))
    )
    owner = F.when(F.col("shard").isNotNull(), F.struct(F.col("cell").alias("arc"), "shard"))
    # read backwards, so that each frame grows by a row; past the last virtual node the ring starts again
    onwards = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.coalesce(F.last(owner, ignorenulls=True).over(onwards), F.last(owner, ignorenulls=True).over(whole))
    return spark.range(0, cells, 1, 1).withColumnRenamed("id", "cell").join(nodes, "cell", "left").select("cell", at.alias("o")).select("cell", "o.arc", "o.shard")


def _walk(arcs: DataFrame, shards: int, load_factor: float) -> DataFrame:
    """Two laps round the ring as one fold over the arcs: ``(step, arc, shard, own, over, taken)``.

    ``own``: rows of the arc that its shard takes; ``over``: rows that go on; ``taken``: rows carried here
    from earlier arcs. The second lap only carries. Arcs that keep just their own rows are left out. Capacities are the exact shares (at most one apart)
    for ``load_factor`` 0, else ``ceil((1 + load_factor) * mean)``.
    """
    total = F.coalesce(F.sum("load"), F.lit(0)).cast("bigint")
    one = arcs.agg(F.array_sort(F.collect_list(F.struct("arc", "shard", "load"))).alias("arcs"), total.alias("n"))
    share = f"n div {shards} + if(i < n % {shards}, 1L, 0L)" if load_factor == 0 else f"cast(ceil((1 + {load_factor}D) * n / {shards}) as bigint)"
    laps = "concat(arcs, transform(arcs, a -> named_struct('arc', a.arc, 'shard', a.shard, 'load', 0L)))"
    start = (
        f"named_struct('room', transform(sequence(0, {shards - 1}), i -> {share}), 'carry', 0L, "
        "'out', cast(array() as array<struct<arc:bigint,shard:int,own:bigint,over:bigint,taken:bigint>>))"
    )
    own = "least(x.load, s.room[x.shard])"
    taken = f"least(s.carry + x.load - {own}, s.room[x.shard] - {own})"
    step = (
        f"named_struct('room', transform(s.room, (r, i) -> if(i = x.shard, r - {own} - {taken}, r)), "
        f"'carry', s.carry + x.load - {own} - {taken}, "
        f"'out', if(x.load = {own} and {taken} = 0, s.out, concat(s.out, array(named_struct('arc', x.arc, 'shard', x.shard, 'own', {own}, 'over', x.load - {own}, 'taken', {taken})))))"
    )
    # one row of bounded size, written first: the explode below would otherwise fold again for each of its filters
    return staged(one.select(F.expr(f"aggregate({laps}, {start}, (s, x) -> {step}, s -> s.out)").alias("out"))).selectExpr("posexplode(out) as (step, o)").select("step", "o.*")


def _pieces(arcs: DataFrame, walk: DataFrame) -> DataFrame:
    """``(arc, first, last, shard, base)``: ranks first <= r < last of an arc go to ``shard``, slots from ``base``."""
    so_far = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = walk.withColumns({"e": F.sum("over").over(so_far) - F.col("over"), "c": F.sum("taken").over(so_far) - F.col("taken"), "end": F.sum("over").over(everything)})
    # overflow rows queue in ring order; where a stretch of sources meets a stretch of takers, both ends cut it
    leaves = w.where("over > 0").select(F.col("e").alias("p"), F.struct("arc", "own", "e").alias("source"), F.lit(None).cast("int").alias("shard"), "end")
    lands = w.where("taken > 0").select(F.col("c").alias("p"), F.lit(None).cast("struct<arc:bigint,own:bigint,e:bigint>").alias("source"), "shard", "end")
    line = Window.orderBy("p", F.col("shard").isNull())
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        leaves.unionByName(lands)
        .select("p", F.last("source", True).over(upto).alias("s"), F.last("shard", True).over(upto).alias("shard"), F.coalesce(F.lead("p").over(line), F.col("end")).alias("q"))
        .where("q > p")
        .select("s.arc", (F.col("s.own") + F.col("p") - F.col("s.e")).alias("first"), (F.col("s.own") + F.col("q") - F.col("s.e")).alias("last"), "shard", F.lit(1).alias("kind"))
    )
    kept = arcs.join(w.where("over > 0").select("arc", "own"), "arc", "left").select("arc", "shard", F.coalesce("own", "load").alias("own"))
    home = kept.where("own > 0").select("arc", F.lit(0).cast("bigint").alias("first"), F.col("own").alias("last"), "shard", F.lit(0).alias("kind"))
    order = Window.partitionBy("shard").orderBy("kind", "arc", "first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.col("last") - F.col("first")
    return home.unionByName(cut).select("arc", "first", "last", "shard", (F.sum(n).over(order) - n).alias("base"))


def shard(rows: DataFrame, key: Column, shards: int, vnodes: int = 128, load_factor: float = 0.0, order: list[Column] | None = None, cells: int = CELLS) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard) to ``rows``.

    key: the ring key, any type; a null key is a key like any other.
    load_factor: 0 makes the shards' row counts at most one apart; above, a shard holds up to
    ``ceil((1 + load_factor) * mean)`` rows and fewer rows leave their home shard.
    order: columns that make ranks within a cell repeatable; rows equal in the key and in all of them
    can change places. An empty table gives an empty result. Columns of ``rows`` stay, under any names
    but ``shard`` and ``slot``, which are replaced.
    """
    spark, names = rows.sparkSession, [c for c in rows.columns if c not in ("shard", "slot")]
    held = rows.select(F.struct(*names).alias("row"), F.pmod(F.xxhash64(key), F.lit(cells)).alias("cell"), F.struct(F.xxhash64(key, F.lit(1)), *(order or [key])).alias("by"))
    owners = ring(spark, shards, vnodes, cells)
    counts = held.groupBy("cell").agg(F.count("*").alias("n"))
    in_arc = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = owners.join(counts, "cell").select("cell", "arc", "shard", "n", (F.sum("n").over(in_arc) - F.col("n")).alias("before"))
    arcs = owners.groupBy("arc").agg(F.min("shard").alias("shard")).join(filled.groupBy("arc").agg(F.sum("n").alias("load")), "arc", "left").fillna(0, ["load"])
    arcs = staged(arcs)
    pieces = _pieces(arcs, _walk(arcs, shards, load_factor))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("by")) - 1
    # both lookups are bounded by the ring's parameters: at most `cells` rows, and a few for each virtual node
    placed = held.select("row", "cell", rank.alias("r")).join(F.broadcast(filled.select("cell", "arc", "before")), "cell").select("row", "arc", (F.col("r") + F.col("before")).alias("r"))
    return placed.join(F.broadcast(pieces), "arc").where("r >= first and r < last").select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("r") - F.col("first")).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` on shards 0 to 39, counts at most one apart (law ``rows``); null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"))
    placed = shard(docs, F.col("doc_id"), 40, order=[F.col("size"), F.col("text_crc32")])
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))
