"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking.

Rotations for balanced binary codes are learned on at most `sample` vectors (chosen by a hash of the id): principal
directions, then in turns the signs of the rotated vectors and the rotation that fits the signs best. Every vector is
coded with each rotation. Codes are cut into substrings, one hash table for each; the substring's length follows the
logarithm of the number of vectors, so buckets keep their mean size as the input grows. A longer substring is equal less
often, so the number of rotations follows the length: a pair at the wanted cosine shares a bucket with the chance `recall`
at every size. Vectors of one bucket whose codes differ in few bits are candidates, and candidates are reranked by cosine
in double precision.

Equal vectors form a class and are indexed once. Keys are shuffled once, with two codes and without vectors. The candidates of
a bucket with few of them for its rows leave it as pairs, and each pair is reranked once. Other buckets are dense: their
vectors come to them, large ones are cut into blocks, and each two blocks meet in a cell, where links are counted and only
the sums and one edge per vector leave, never the pairs. A cell of many rows is compared by one matrix product. A pair that
meets in several tables counts in the first one. A bucket that holds a large part of all rows is dealt out to its blocks by a
broadcast of its size, not by a shuffle on its key.

Vectors of each dimension are linked among themselves, through tables at every size: few vectors have short substrings.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; ties and repeated rows link as equal vectors do; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.components import components
from corpusloom.llm.joins import by_key, hot_keys
from corpusloom.runtime import drop, settle, ship, table


@dataclass(frozen=True)
class Options:
    cosine: float = 0.9
    sample: int = 20_000
    #: The least number; more are learned where `recall` needs more tables.
    rotations: int = 8
    recall: float = 0.99
    #: Mean size of a bucket, which sets the substring's length, unless a length is given.
    bucket: int = 8
    length: int | None = None
    bits: int = 64
    turns: int = 30
    #: Standard deviations of the number of differing bits, above what the cosine makes expect, up to which a pair is a candidate;
    #: a given share of differing bits takes its place.
    spread: float = 5.0
    max_bits_apart: float | None = None
    block: int = 512
    #: Rows of a cell from which on it is compared by a matrix product.
    product: int = 48
    #: Codes that candidates in the tables are judged by.
    judges: int = 2
    #: Candidates for each row of a bucket above which it is dense.
    dense: int = 16


def tables_needed(length: int, cosine: float, recall: float) -> int:
    """Tables of substrings of this length in one of which a pair at the cosine meets with the chance `recall`."""
    equal = (1 - math.acos(min(max(cosine, -1.0), 1.0)) / math.pi) ** length
    return 1 if equal >= recall else math.ceil(math.log(1 - recall) / math.log1p(-max(equal, 1e-9)))


def learn_rotations(x: np.ndarray, options: Options) -> list[np.ndarray]:
    """Projections (dimension by bits) of unit vectors, each from another random start."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    bits = min(options.bits, x.shape[1])
    _, directions = np.linalg.eigh(x.T @ x)
    principal = directions[:, ::-1][:, :bits]
    v = x @ principal
    found = []
    for k in range(options.rotations):
        r = np.linalg.qr(np.random.default_rng(k).normal(size=(bits, bits)))[0]
        for _ in range(options.turns):
            signs = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(v.T @ signs)
            r = u @ w
        found.append(principal @ r)
    return found


def codes_of(x: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    """One 64-bit word for each vector and rotation."""
    out = np.zeros((len(x), len(rotations)), dtype=np.uint64)
    for k, r in enumerate(rotations):
        on = np.zeros((len(x), 64), dtype=np.uint8)
        on[:, : r.shape[1]] = x @ r >= 0
        out[:, k] = np.packbits(on, axis=1).view(np.uint64)[:, 0] if len(x) else 0
    return out


def substrings(codes: np.ndarray, bits: int, length: int) -> np.ndarray:
    """(vectors, tables): the substrings of all codes; the last one of a code may overlap the one before."""
    starts = list(range(0, bits - length + 1, length)) or [0]
    columns = []
    words = codes.astype(">u8").view(np.uint8).reshape(len(codes), codes.shape[1], 8)[:, :, ::-1] if len(codes) else np.zeros((0, codes.shape[1], 8), dtype=np.uint8)
    on = np.unpackbits(np.ascontiguousarray(words), axis=2)
    weight = (1 << np.arange(length, dtype=np.int64))[::-1]
    for k in range(codes.shape[1]):
        for s in starts:
            columns.append(on[:, k, s : s + length].astype(np.int64) @ weight[: min(length, 64 - s)])
    return np.stack(columns, axis=1)


def substring_masks(bits: int, length: int) -> np.ndarray:
    """The bits of a code that each of its substrings reads."""
    starts = list(range(0, bits - length + 1, length)) or [0]
    on = np.zeros((len(starts), 64), dtype=np.uint8)
    for k, s in enumerate(starts):
        on[k, s : s + length] = 1
    return np.packbits(on, axis=1).view(np.uint64)[:, 0]


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1).astype(dtype, copy=False) if len(column) else flat.reshape(0, 1).astype(dtype)


def _cells(keys: DataFrame, partitions: int, options: Options) -> DataFrame:
    """Rows with a column key, copied to the cells of their bucket's blocks (lo, hi; own block i), sorted by cell."""
    counts = settle(keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
    rows = by_key(keys, counts, hot_keys(counts, "key"), "key").withColumn("g", F.ceil(F.col("m") / options.block).cast("int"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")}).drop("m", "g", "j")
    order = ["key", "lo", "hi"]
    return rows.repartition(partitions, *order).sortWithinPartitions(*order)


#: Keys of one vector of so many tell which buckets are larger than a block.
LAID_OUT_BY = 16


def _first_cells(keys: DataFrame, some: DataFrame, partitions: int, options: Options) -> DataFrame:
    """The same in one shuffle, with g, the number of a bucket's blocks: the layout comes from the keys of `some` rows, one in
    LAID_OUT_BY; it sets the cells' sizes and not what meets."""
    sizes = some.groupBy("key").agg((F.count("*") * LAID_OUT_BY).alias("m")).filter(F.col("m") > options.block)
    sizes = settle(sizes.select("key", F.ceil(F.col("m") / options.block).cast("int").alias("g")), "large-buckets")
    rows = keys.join(F.broadcast(sizes), "key", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")}).drop("j")
    order = ["key", "lo", "hi"]
    return rows.repartition(partitions, *order).sortWithinPartitions(*order)


def _meetings(key, lo, hi, i):
    """All pairs of rows of one cell, as index arrays, shift by shift; in a cell of two blocks, pairs across them."""
    at = np.arange(len(key))
    d = 0
    while len(at):
        d += 1
        at = at[at + d < len(key)]
        at = at[(key[at] == key[at + d]) & (lo[at] == lo[at + d]) & (hi[at] == hi[at + d])]
        pair = at[(lo[at] == hi[at]) | (i[at] != i[at + d])]
        if len(pair):
            yield pair, pair + d


def _whole_cells(batches):
    """Tables that end where a cell ends."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None and held.num_rows else t
        k, lo, hi = (t[c].to_numpy() for c in ("key", "lo", "hi"))
        cuts = np.flatnonzero((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        end = int(cuts[-1]) if len(cuts) else 0
        if end:
            yield t.slice(0, end).combine_chunks()
        held = t.slice(end)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _large_cells(key, lo, hi, least: int):
    """(first, end) of the cells of at least so many rows, and the rows of all other cells."""
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))) if len(key) else np.zeros(0, dtype=int)
    sizes = np.diff(np.append(new, len(key)))
    large = sizes >= least
    return list(zip(new[large].tolist(), (new + sizes)[large].tolist())), np.flatnonzero(np.repeat(~large, sizes))


def _first_met(codes: np.ndarray, masks: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each pair of rows meets in no table before the given one."""
    alive = np.arange(len(a))
    for k in range(int(table.max(initial=0))):
        turn, mask = divmod(k, len(masks))
        x, y = a[alive], b[alive]
        met = ((codes[x, turn] ^ codes[y, turn]) & masks[mask] == 0) & (k < table[alive])
        alive = alive[~met]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def _near(codes: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(codes[a] ^ codes[b]).sum(1, dtype=np.int64) <= most


def _link_classes(classes: DataFrame, n: int, kind: str, n_parts: int, options: Options) -> DataFrame:
    """(embedding, links, component) of n classes (embedding, rep, mult) of one dimension."""
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(options.sample).select("embedding").toArrow()
    x = _matrix(sample["embedding"], np.float64)
    bits = min(options.bits, x.shape[1])
    length = max(1, min(bits // 2, 48, options.length or math.ceil(math.log2((n + 1) / options.bucket))))
    masks = substring_masks(bits, length)
    in_tables = max(2, math.ceil(tables_needed(length, options.cosine, options.recall) / len(masks)))
    rotations = learn_rotations(x, replace(options, rotations=max(options.rotations, in_tables)))
    judges = min(options.judges, len(rotations))
    apart = math.acos(options.cosine) / math.pi
    all_bits = bits * judges
    most = int(all_bits * (options.max_bits_apart or apart) + (0 if options.max_bits_apart else 1 + options.spread * math.sqrt(all_bits * apart * (1 - apart))))

    def encode(batches):
        for batch in batches:
            codes = codes_of(_matrix(batch.column(0), np.float64), rotations)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(0), pa.array(list(codes.view(np.int64)), type=pa.list_(pa.int64()))], names=["rep", "mult", "embedding", "codes"]
            )

    coded = classes.select("embedding", "rep", "mult").mapInArrow(encode, f"rep {kind}, mult bigint, embedding array<double>, codes array<bigint>")
    coded = settle(coded, "coded")
    few = [f"c{k}" for k in range(judges)]

    def keyed(batches):
        for batch in batches:
            codes = _matrix(batch.column(1), np.int64).view(np.uint64)
            judged = [pa.array(codes[:, k].view(np.int64)) for k in range(judges)]
            for k in range(in_tables):
                keys = substrings(codes[:, k : k + 1], bits, length)
                for j in range(keys.shape[1]):
                    key = keys[:, j] | np.int64(k * len(masks) + j) << 48
                    yield pa.RecordBatch.from_arrays([batch.column(0), *judged, pa.array(key)], names=["rep", *few, "key"])

    def candidates(batches):
        """(rep, other, key): candidate pairs of buckets with few of them; without another, a row of a dense bucket that has a candidate."""
        for t in _whole_cells(batches):
            codes = np.stack([t[c].to_numpy() for c in few], axis=1).view(np.uint64)
            key, lo, hi, i, g = (t[c].to_numpy() for c in ("key", "lo", "hi", "i", "g"))
            cell = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
            n_cells = int(cell[-1]) + 1
            size, near_ones = np.bincount(cell), np.zeros(n_cells, dtype=np.int64)
            dense = np.zeros(n_cells, dtype=bool)
            dense[cell[g > 1]] = True  # a bucket is dense in all its blocks or in none
            on, kept = np.zeros(t.num_rows, dtype=bool), []
            for a, b in _meetings(key, lo, hi, i):
                some = ~(dense[cell[a]] & on[a] & on[b])  # both are known to have a near one
                a, b = a[some], b[some]
                near = _near(codes, a, b, most)
                a, b = a[near], b[near]
                on[a] = on[b] = True
                near_ones += np.bincount(cell[a], minlength=n_cells)
                dense |= near_ones > options.dense * size
                alone = ~dense[cell[a]]
                kept.append((a[alone], b[alone]))
            a, b = (np.concatenate(p) for p in zip(*kept)) if kept else (np.zeros(0, dtype=int), np.zeros(0, dtype=int))
            alone = ~dense[cell[a]]
            a, b = a[alone], b[alone]
            first = _first_met(codes, masks, a, b, np.minimum(key[a] >> 48, judges * len(masks)))
            a, b = a[first], b[first]
            rep, rows = t["rep"].combine_chunks(), np.flatnonzero(on & dense[cell])
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(a)), rep.take(pa.array(b)), pa.array(key[a])], names=["rep", "other", "key"])
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(rows)), pa.nulls(len(rows), rep.type), pa.array(key[rows])], names=["rep", "other", "key"])

    codes_of_rows = f"rep {kind}, {', '.join(c + ' bigint' for c in few)}, key bigint"
    keys = coded.select("rep", "codes").mapInArrow(keyed, codes_of_rows)
    some = coded.filter(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(LAID_OUT_BY)) == 0).select("rep", "codes").mapInArrow(keyed, codes_of_rows).select("key")
    met = settle(_first_cells(keys, some, n_parts, options).mapInArrow(candidates, f"rep {kind}, other {kind}, key bigint"), "candidates")
    pairs = met.filter("other IS NOT NULL").groupBy(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
    pairs = pairs.agg(F.min(F.shiftright("key", 48)).alias("first"))
    active = settle(met.filter("other IS NULL").select("rep", "key").distinct(), "active")

    def rerank(batches):
        """(rep, links, root), two rows for each pair at the cosine that meets in no table before the first one with few candidates."""
        for batch in batches:
            for begin in range(0, batch.num_rows, 2_000):
                part = batch.slice(begin, 2_000)
                n = part.num_rows
                x, y = (_matrix(part.column(c), np.float64) for c in ("x", "y"))
                good = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= options.cosine
                codes = np.concatenate([_matrix(part.column(c), np.int64) for c in ("u", "v")]).view(np.uint64)
                good = pa.array(good & _first_met(codes, masks, np.arange(n), np.arange(n) + n, part.column("first").to_numpy()))
                a, b, m, k = (part.column(c).filter(good) for c in ("a", "b", "m", "k"))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([k, m]), pa.concat_arrays([a, a])], names=["rep", "links", "root"])

    left = coded.select(F.col("rep").alias("a"), F.col("mult").alias("m"), F.col("embedding").alias("x"), F.col("codes").alias("u"))
    right = coded.select(F.col("rep").alias("b"), F.col("mult").alias("k"), F.col("embedding").alias("y"), F.col("codes").alias("v"))
    apart_found = pairs.join(left, "a").join(right, "b").mapInArrow(rerank, f"rep {kind}, links bigint, root {kind}")

    def count_links(batches):
        for t in _whole_cells(batches):
            codes = _matrix(t["codes"], np.int64).view(np.uint64)
            x = _matrix(t["embedding"], np.float64)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            mult, rep = t["mult"].to_numpy(), t["rep"].to_numpy()
            key = t["key"].to_numpy()
            lo, hi, i = (t[c].to_numpy() for c in ("lo", "hi", "i"))
            links, linked = np.zeros(t.num_rows, dtype=np.int64), []
            large, others = _large_cells(key, lo, hi, options.product)

            def alike():
                """Pairs of rows at the cosine, of large cells by a product, of others one by one."""
                for first, end in large:
                    at = np.arange(first, end)
                    left, right = (at, at) if lo[first] == hi[first] else (at[i[at] == lo[first]], at[i[at] == hi[first]])
                    near_a, near_b = np.nonzero(x[left] @ x[right].T >= options.cosine)
                    a, b = left[near_a], right[near_b]
                    yield (a[a < b], b[a < b]) if lo[first] == hi[first] else (a, b)
                for a, b in _meetings(*(v[others] for v in (key, lo, hi, i))):
                    a, b = others[a], others[b]
                    near = _near(codes[:, :judges], a, b, most)
                    a, b = a[near], b[near]
                    good = np.einsum("ij,ij->i", x[a], x[b]) >= options.cosine
                    yield a[good], b[good]

            for a, b in alike():
                first = _first_met(codes, masks, a, b, key[a] >> 48)
                a, b = a[first], b[first]
                links += np.bincount(a, mult[b], t.num_rows).astype(np.int64) + np.bincount(b, mult[a], t.num_rows).astype(np.int64)
                if len(a):
                    linked.append((a, b))
            root = np.arange(t.num_rows)
            if linked:
                a, b = (np.concatenate(p) for p in zip(*linked))
                rank = np.argsort(np.argsort(rep, kind="stable"), kind="stable")
                by_rank = np.argsort(rank)
                label = rank.copy()
                while True:  # the smallest id that links reach within the cell
                    low = label.copy()
                    np.minimum.at(low, a, label[b])
                    np.minimum.at(low, b, label[a])
                    low = np.minimum(low, low[by_rank[low]])
                    if (low == label).all():
                        break
                    label = low
                root = by_rank[label]
            on = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(rep[on], type=t["rep"].type), pa.array(links[on]), pa.array(rep[root][on], type=t["rep"].type)], names=["rep", "links", "root"])

    if not active.isEmpty():
        apart_found = apart_found.unionByName(_cells(coded.join(active, "rep"), n_parts, options).mapInArrow(count_links, f"rep {kind}, links bigint, root {kind}"))
    found = settle(apart_found, "links")
    drop(met)
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_class = coded.select("rep", "mult", "embedding").join(totals, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    return settle(
        of_class.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component")),
        "class-links",
    )


def link(vectors: DataFrame, options: Options = Options(), partitions: int | None = None) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    n_parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", e.cast("array<double>").alias("embedding")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    classes = rows.filter("fine and vec_id is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    classes = settle(classes, "classes")
    sizes = classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    linked = [_link_classes(classes.filter(F.size("embedding") == one["d"]), one["n"], kind, n_parts, options) for one in sizes]
    of_class = reduce(DataFrame.unionByName, linked)
    out = rows.join(of_class.withColumn("fine", F.lit(True)), ["embedding", "fine"], "left")
    alone = F.col("links").isNull() | F.col("vec_id").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        "vec_id",
        F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


#: Cosines of turned copies with their vectors; one of them is no link.
TURNED = (0.905, 0.93, 0.95, 0.88)


def turned_copies(vectors: DataFrame) -> DataFrame:
    """Vectors (vec_id, embedding), numbered 8 by 8, with copies turned towards their own reverse by the angles of TURNED."""
    e = F.col("e")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    d = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    d = d.withColumn("e", F.transform("e", lambda x: x / F.sqrt(dot(e, e))))
    d = d.withColumn("w", F.zip_with(F.reverse("e"), "e", lambda r, x: r - x * dot(F.reverse(e), e)))
    d = d.withColumn("w", F.transform("w", lambda x: x / F.sqrt(dot(F.col("w"), F.col("w")))))
    turned = lambda c: F.zip_with("e", "w", lambda x, y: x * c + y * (1 - c * c) ** 0.5)
    copies = [turned(c) for c in TURNED]
    return d.select(F.col("vec_id"), F.posexplode(F.array("e", *copies)).alias("k", "embedding")).select((F.col("vec_id") * 8 + F.col("k")).alias("vec_id"), "embedding")


def planted(spark, sf_dir: str) -> DataFrame:
    """Links among `embeddings` and turned copies of them, which the table itself has none of. So many tables that a pair at the cosine is
    missed once in a million."""
    return link(turned_copies(table(spark, sf_dir, "embeddings")), Options(recall=1 - 1e-6, bucket=64))


ORACLE_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT x.vec_id, (SELECT count(*) FROM l WHERE l.a = x.vec_id) AS n_links, c.component_id, x.vec_id = c.component_id AS kept
FROM embeddings x JOIN (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1) c USING (vec_id)
"""


PLANTED_SQL = f"""
WITH RECURSIVE u AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
r AS (SELECT vec_id, e, list_transform(range(1, len(e) + 1), lambda i: list_reverse(e)[i] - e[i] * list_dot_product(list_reverse(e), e)) AS w FROM u),
w AS MATERIALIZED (SELECT vec_id, e, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS w FROM r),
v AS MATERIALIZED (SELECT vec_id * 8 AS vec_id, e FROM w {' '.join(f"UNION ALL SELECT vec_id * 8 + {k + 1}, list_transform(range(1, len(e) + 1), lambda i: e[i] * {c} + w[i] * {(1 - c * c) ** 0.5!r}) FROM w" for k, c in enumerate(TURNED))}),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9),
t AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a AS vec_id, min(b) AS component_id FROM t GROUP BY 1) c USING (vec_id)
"""
