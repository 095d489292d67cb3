"""Sharding along a Hilbert curve, in DataFrame expressions only.

Three metadata dimensions are quantised to a grid: language and source by the rank of the value among the table's values
(up to 2**BITS values get a cell each, spread over the side; more are cut, in their order, in as many ranges), and the
text's size by its binary logarithm. Neighbouring cells hold neighbouring values, so that the order survives which minima
and maxima are compared in. Rows are sorted by their index on the curve, then by id, and the order is cut into runs of
equal numbers of rows, so each shard covers a compact box in all three dimensions at once and a reader that filters on any
of them can skip files by their minima and maxima.

Texts are read once; what is sorted are their sizes, checksums and metadata, written to the shared folder.

Law `rows`: shard sizes differ by one row at most. Nulls in a dimension share the first cell; a missing column is one
cell; a null text has no bytes; repeated rows and ties take neighbouring places (an order among identical rows makes no
difference); an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.runtime import settle, table

BITS = 5
SHARDS = 40
OVERHEAD = 16


def hilbert_index(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """The place of a point of the grid [0, 2**bits)**3 on the Hilbert curve.

    From the highest bit down, each plane swaps or inverts the lower bits (one step of `aggregate`, whose state holds
    the three coordinates); then the Gray code is undone and the bits are interleaved."""
    state = F.struct(*[c.cast("int").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))])
    planes = F.array(*[F.lit(1 << k) for k in range(bits - 1, 0, -1)])

    def step(s: Column, q: Column) -> Column:
        low = q - 1
        on = lambda c: c.bitwiseAND(q) != 0
        x0 = F.when(on(s["x"]), s["x"].bitwiseXOR(low)).otherwise(s["x"])
        ty = x0.bitwiseXOR(s["y"]).bitwiseAND(low)
        x1 = F.when(on(s["y"]), x0.bitwiseXOR(low)).otherwise(x0.bitwiseXOR(ty))
        y1 = F.when(on(s["y"]), s["y"]).otherwise(s["y"].bitwiseXOR(ty))
        tz = x1.bitwiseXOR(s["z"]).bitwiseAND(low)
        x2 = F.when(on(s["z"]), x1.bitwiseXOR(low)).otherwise(x1.bitwiseXOR(tz))
        z1 = F.when(on(s["z"]), s["z"]).otherwise(s["z"].bitwiseXOR(tz))
        return F.struct(x2.alias("x"), y1.alias("y"), z1.alias("z"))

    def finish(s: Column) -> Column:
        gy = s["y"].bitwiseXOR(s["x"])
        gz = s["z"].bitwiseXOR(gy)
        t = F.lit(0)
        for k in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(gz.bitwiseAND(F.lit(1 << k)) != 0, F.lit((1 << k) - 1)).otherwise(F.lit(0)))
        out = F.lit(0).cast("long")
        for axis, c in enumerate((s["x"], gy, gz)):
            v = c.bitwiseXOR(t)
            for k in range(bits):
                out = out + F.shiftright(v, k).bitwiseAND(F.lit(1)).cast("long") * (1 << (3 * k + 2 - axis))
        return out

    return F.aggregate(planes, state, step, finish)


def first_values(rows: DataFrame, name: str, cells: int) -> list[str]:
    """The first value of each cell, in order: all distinct values where they are no more than the cells, else the first
    value of each of as many ranges of them, found by a range-partitioned deal of the distinct values."""
    values = rows.select(F.col(name).alias("v")).filter("v is not null").distinct()
    some = values.orderBy("v").limit(cells + 1).collect()
    if len(some) <= cells:
        return [r["v"] for r in some]
    ranges = values.repartitionByRange(cells, "v").groupBy(F.spark_partition_id().alias("p")).agg(F.min("v").alias("v"))
    found = sorted(r["v"] for r in ranges.orderBy("p").collect())
    return [found[k * len(found) // cells] for k in range(cells)] if len(found) > cells else found


def rank_cell(name: str, firsts: list[str], cells: int) -> Column:
    """The cell of a value: its range's number, spread over the side."""
    if not firsts:
        return F.lit(0)
    at = F.size(F.filter(F.array(*map(F.lit, firsts)), lambda x: x <= F.col(name)))
    at = F.greatest(F.when(F.col(name).isNull(), F.lit(1)).otherwise(at), F.lit(1)) - 1
    return F.floor(at * cells / len(firsts)).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, partitions: int | None = None, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, lang, source, size, text_crc32, hilbert, shard and slot.

    Ranks come from a range-partitioned sort: each row's place in its partition plus the rows of the partitions
    before, of which there is one count for each partition. No window over all rows is used."""
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    side = 1 << bits
    text = F.coalesce(F.col("text"), F.lit(""))
    tag = lambda name: (F.col(name) if name in docs.columns else F.lit(None)).cast("string").alias(name)
    d = docs.select(
        "doc_id",
        tag("lang"),
        tag("source"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    d = settle(d, "shard-rows")  # range partitioning reads its input twice
    tags = [rank_cell(name, first_values(d, name, side), side) for name in ("lang", "source")]
    by_size = F.least(F.lit(side - 1), F.floor(F.log2(F.col("size") - OVERHEAD + 1.0) * 1.5).cast("int"))
    d = d.withColumn("hilbert", hilbert_index(*tags, by_size, bits))
    order = ["hilbert", "doc_id", "text_crc32", "size"]
    placed = d.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = settle(placed, "shard-order").withColumn("_part", F.shiftright(F.col("_place"), 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition: the only rows that this window holds
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_rows"))
    ranked = placed.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    ranked = ranked.withColumn("shard", F.expr(f"cast(_rank * {shards} div _rows as int)"))
    first = F.expr(f"(_rows * shard + {shards - 1}L) div {shards}L")
    return ranked.withColumn("slot", (F.col("_rank") - first).cast("long")).drop("_rank", "_place", "_part", "_before", "_rows")


def query(spark, sf_dir: str) -> DataFrame:
    d = shard(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
