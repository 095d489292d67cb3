"""N-gram Jaccard self-join: a size-aware heavy-light join.

A document is the set of hashes of its distinct shingles of five words. Two documents link when the Jaccard similarity
of their sets is at least `percent`. Documents with equal sets form a class; only classes are joined.

Light sets (at most `boundary` shingles) enumerate all subsets of two shingles of a prefix; heavy sets enter each
shingle of a prefix in an inverted list. The boundary is the one of least cost over the histogram of set sizes: a light
set costs its number of subsets, a heavy one its list entries times the cost of scanning an entry's list. Sets near the
boundary enter the lists too, so that light and heavy sets meet. Prefixes are in the order of the hashes: two sets that
link share `depth` elements among the first n - c + depth of each, c being the least overlap that a set of n needs.

The cost of an entry is measured: from the list keys of every 64th class (by its signature), the mean length of the list
that an entry meets.

1. Keys go, packed, to buckets by their value; a bucket gives back the keys that two classes have in common. A bucket with
   far more keys than the mean has a hot key; its keys become rows, which are made distinct and counted with map-side
   aggregation instead.
2. A class with fewer common keys than any link needs is out; in what is left, each class keeps the prefix of its rarest
   common keys, which is where a partner must show.
3. Each class is compared with the class that it shares most keys with among the first ones of its lists: one exact
   comparison each, whatever the size of a group.
4. Lists whose classes are connected by now are done. In the others, classes of different components are joined by list:
   a list is cut by set size so that only sizes that can link meet, then in blocks; a bound on the overlap (from parity
   bits of both sets) drops most pairs before the exact comparison.

No list, group or component is gathered in one task. Tables with a row for each key join lists in two parts: keys with more
than a small part of all entries, of which there can only be few, are broadcast, and all others are shuffled.

Defined results: null and empty texts, and those without words, have no shingles and link with nothing; fewer words
than a shingle form one shingle; repeated rows of one id are one document in each of their rows; rows without an id
have no component; an empty table gives an empty result; other columns are ignored by `link` and kept by
`keep_first`.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.components import components
from corpusloom.llm.joins import by_key, hot_keys
from corpusloom.llm.kernels import mix, shingle_sets
from corpusloom.runtime import drop, settle, ship, table

BITMAP_LONGS = 32
#: Keys that a task packs at a time, and sets that it remembers.
HELD_KEYS, SEEN_SETS = 500_000, 200_000
#: One class of so many gives its list keys to measure the lists' length.
SAMPLED = 64
#: Ids up to which a table of ids is broadcast to the texts or sets that it picks, which then stay where they lie: about 50 MB.
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class Options:
    shingle: int = 5
    percent: int = 75
    #: Cost of meeting one more entry of a list, against that of making, sending and counting one key.
    meeting_cost: float = 0.05
    largest_boundary: int = 64
    bucket_keys: int = 1_000_000
    #: A bucket with so many keys, and so many times the mean, is taken apart.
    hot_bucket: int = 250_000
    hot_times: float = 4.0
    #: Rows of a list that are compared with one another in one place.
    block: int = 512


def least_overlap(n, percent: int):
    """The fewest elements that a set of n shares with any set it links with."""
    return -(-n * percent // 100)


def depth(n, percent: int):
    """How many common elements a set of n is to show in its prefix, at most."""
    return least_overlap(n, percent) // 4 + 1


def least_depth(n, percent: int):
    """The same, for the smallest partner of a set of n."""
    return depth(least_overlap(n, percent), percent)


def links(a: int, b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def boundary(histogram: dict[int, int], options: Options, others_met: float) -> int:
    """The set size up to which enumerating subsets costs less than scanning lists, in which an entry meets so many others."""
    best, at = None, 0
    list_cost = 1 + options.meeting_cost * min(others_met, options.block)
    for limit in range(0, options.largest_boundary + 1):
        cost = 0.0
        for n, count in histogram.items():
            p = n - least_overlap(n, options.percent)
            if n <= limit:
                cost += count * (p + 2) * (p + 1) / 2
            if n >= least_overlap(limit + 1, options.percent):
                cost += count * (p + depth(n, options.percent)) * list_cost
        if best is None or cost < best:
            best, at = cost, limit
    return at


def keys_of(s: np.ndarray, light_up_to: int, options: Options) -> np.ndarray:
    """The join keys of a sorted set: subsets of two from a prefix if it is light, list keys if it is not or nearly not."""
    n = len(s)
    p = n - least_overlap(n, options.percent)
    found = []
    if n <= light_up_to and n > 1:
        head = s[: p + 2]
        i, j = np.triu_indices(len(head), 1)
        found.append(mix(head[i] * np.uint64(0x9E3779B97F4A7C15) + mix(head[j])))
    if n >= least_overlap(light_up_to + 1, options.percent):
        found.append(s[: p + depth(n, options.percent)])
    return np.concatenate(found) if found else s[:0]


def _signature(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return tuple(int(x) for x in np.frombuffer(d, dtype=np.int64))


def describe(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, sampled): the size and the 128-bit signature of each document's set, and the list keys
    of those sets whose signature falls in the sample."""
    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, marks, sampled = [], [], []
            for _, s in shingle_sets(batch.column(1), options.shingle):
                mark = _signature(s)
                n.append(len(s))
                marks.append(mark)
                sampled.append(keys_of(s, 0, options).view(np.int64) if mark[0] % SAMPLED == 0 and len(s) else None)
            s1, s2 = zip(*marks) if marks else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, type=pa.int64()) for x in (n, s1, s2)], pa.array(sampled, type=pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "s1", "s2", "sampled"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_shingles bigint, s1 bigint, s2 bigint, sampled array<bigint>")


def others_met(classes: DataFrame) -> float:
    """How many other entries an entry of a list meets on the mean, from the classes with sampled keys: a list of which c
    entries are sampled has c (c - 1) sampled pairs, and SAMPLED squared as many in truth."""
    lists = classes.filter("sampled is not null").select(F.explode("sampled").alias("key")).groupBy("key").agg(F.count("*").alias("c"))
    entries, pairs = lists.agg(F.sum("c"), F.sum(F.col("c") * (F.col("c") - 1.0))).first()
    return SAMPLED * float(pairs) / float(entries) if entries else 0.0


def _packed_keys(docs: DataFrame, light_up_to: int, buckets: int, options: Options) -> DataFrame:
    """(bucket, n, keys, owners): n keys of many documents, packed by bucket; an owner is the first half of a signature.

    A set met before in the same task isn't packed again, so a group of copies counts once for each task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, owners, held = [], [], 0

            def flush():
                k, o = np.concatenate(keys), np.concatenate(owners)
                bucket = (k % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                k, o, bucket = k[order], o[order], bucket[order]
                names, cuts = np.unique(bucket, return_index=True)
                ends = [*cuts[1:].tolist(), len(bucket)]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, type=pa.int64()),
                        pa.array([b - a for a, b in zip(cuts.tolist(), ends)], type=pa.int64()),
                        pa.array([k[a:b].tobytes() for a, b in zip(cuts, ends)], type=pa.binary()),
                        pa.array([o[a:b].tobytes() for a, b in zip(cuts, ends)], type=pa.binary()),
                    ],
                    names=["bucket", "n", "keys", "owners"],
                )

            for _, s in shingle_sets(batch.column(0), options.shingle):
                if not len(s):
                    continue
                own = _signature(s)[0]
                if own in seen:
                    continue
                if len(seen) > SEEN_SETS:
                    seen.clear()
                seen.add(own)
                found = keys_of(s, light_up_to, options)
                keys.append(found)
                owners.append(np.full(len(found), own, dtype=np.int64))
                held += len(found)
                if held > HELD_KEYS:
                    yield flush()
                    keys, owners, held = [], [], 0
            if held:
                yield flush()

    return docs.select("text").mapInArrow(run, "bucket bigint, n bigint, keys binary, owners binary")


def _common_keys(packed: DataFrame, partitions: int, options: Options) -> DataFrame:
    """(key, owner, df): keys that two owners or more have, with the number of their owners. A bucket is worked off in one
    place unless it is hot; a hot bucket's keys are counted as rows."""
    buckets = packed.groupBy("bucket").agg(F.sum("n").alias("n"))
    mean = buckets.agg(F.avg("n")).first()[0] or 0
    hot = settle(buckets.filter(F.col("n") > max(options.hot_times * mean, options.hot_bucket)).select("bucket"), "hot-buckets")
    if hot.isEmpty():
        return _common_in_buckets(packed, partitions)

    def rows(batches):
        for batch in batches:
            for k, o in zip(batch.column(0), batch.column(1)):
                k, o = (np.frombuffer(x.as_buffer(), dtype=np.int64) for x in (k, o))
                for i in range(0, len(k), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 50_000]), pa.array(o[i : i + 50_000])], names=["key", "owner"])

    taken = packed.join(F.broadcast(hot), "bucket", "left_semi").select("keys", "owners").mapInArrow(rows, "key bigint, owner bigint")
    taken = settle(taken.distinct(), "hot-entries")
    sizes = settle(taken.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "hot-sizes")
    apart = by_key(taken, sizes.select("key", F.col("m").alias("df")), hot_keys(sizes, "key"), "key")
    cold = packed.join(F.broadcast(hot), "bucket", "left_anti")
    return _common_in_buckets(cold, partitions).unionByName(apart.select("key", "owner", "df"))


def _common_in_buckets(packed: DataFrame, partitions: int) -> DataFrame:
    """The same for buckets of bounded size."""

    def emit(keys, owners):
        if not keys:
            return
        k = np.frombuffer(b"".join(keys), dtype=np.uint64)
        o = np.frombuffer(b"".join(owners), dtype=np.int64)
        order = np.argsort(k, kind="stable")
        k, o = k[order], o[order]
        near = np.zeros(len(k), dtype=bool)
        equal = k[1:] == k[:-1]
        near[1:] |= equal
        near[:-1] |= equal
        k, o = k[near], o[near]
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        k, o = k[new], o[new]
        first = np.ones(len(k), dtype=bool)
        first[1:] = k[1:] != k[:-1]
        df = np.diff(np.append(np.flatnonzero(first), len(k)))
        df = np.repeat(df, df)
        k, o, df = k[df > 1], o[df > 1], df[df > 1]
        for i in range(0, len(k), 50_000):
            j = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[j].view(np.int64)), pa.array(o[j]), pa.array(df[j], type=pa.int64())], names=["key", "owner", "df"])

    def run(batches):
        at, keys, owners = None, [], []
        for batch in batches:
            for bucket, k, o in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if bucket != at:
                    yield from emit(keys, owners)
                    at, keys, owners = bucket, [], []
                keys.append(k.as_py())
                owners.append(o.as_py())
        yield from emit(keys, owners)

    packed = packed.select("bucket", "keys", "owners")
    return packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "key bigint, owner bigint, df bigint")


def _with_sets(docs: DataFrame, options: Options) -> DataFrame:
    """(rep, elements, bits): the whole set of each document, packed, and 2048 parity bits of it."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, sets, bits = batch.column(0), [], []
            for i, (_, s) in enumerate(shingle_sets(batch.column(1), options.shingle)):
                sets.append(s.tobytes())
                parity = (np.bincount((mix(s) % np.uint64(64 * BITMAP_LONGS)).astype(np.int64), minlength=64 * BITMAP_LONGS) & 1).astype(np.uint8)
                bits.append(np.packbits(parity).view(np.int64))
                if len(sets) >= 500 or i + 1 == len(ids):
                    begin = i + 1 - len(sets)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(begin, len(sets)), pa.array(sets, type=pa.binary()), pa.array(bits, type=pa.list_(pa.int64()))], names=["rep", "elements", "bits"]
                    )
                    sets, bits = [], []

    return docs.select("doc_id", "text").mapInArrow(run, f"rep {key}, elements binary, bits array<bigint>")


def _picked(rows: DataFrame, id_: str, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose id is in a settled table of ids; they aren't shuffled up to BROADCAST_IDS ids."""
    ids = ids.select(F.col(column).alias(id_))
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, id_, "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, options: Options) -> DataFrame:
    """The pairs (a, b) of a settled table whose sets link, by exact comparison."""
    key = pairs.schema["a"].dataType.simpleString()
    left = _picked(sets, "rep", pairs, "a").select(F.col("rep").alias("a"), F.col("elements").alias("x"))
    right = _picked(sets, "rep", pairs, "b").select(F.col("rep").alias("b"), F.col("elements").alias("y"))

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                good = []
                for x, y in zip(part.column(2), part.column(3)):
                    x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    good.append(links(len(x), len(y), int((both[1:] == both[:-1]).sum()), options.percent))
                good = pa.array(good, type=pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, f"a {key}, b {key}")


def size_class(n, percent: int):
    """Sets that link are of one class or of neighbouring ones: a class is a little wider than the largest ratio of sizes."""
    return F.floor(F.log(n.cast("double")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")


def _near_pairs(rows: DataFrame, partitions: int, options: Options) -> DataFrame:
    """Pairs (a, b) of one list and of different components that may link: rows (key, c, blocks, rep, n, component, bits).

    c is the size class of a row, and `blocks` how many blocks each class of its list has. Each two blocks of a class, and of
    neighbouring classes, meet in a cell of their own, so a cell holds two blocks of rows at most and a row is copied only
    to cells of sizes that it can link with. Differing parity bits are no more than differing elements, in a part of the
    bits as in all of them, which drops most pairs."""
    key = rows.schema["rep"].dataType.simpleString()
    count = lambda c: F.coalesce(F.try_element_at("blocks", c), F.lit(0))
    numbers = lambda c: F.filter(F.sequence(F.lit(0), F.greatest(count(c), F.lit(1)) - 1), lambda _: count(c) > 0)
    cell = lambda c, across, lo, hi, side: F.struct(c.alias("c"), across.alias("across"), lo.alias("lo"), hi.alias("hi"), side.alias("side"))
    c, i, no, yes = F.col("c"), F.col("i"), F.lit(0), F.lit(1)
    rows = rows.withColumn("i", F.pmod(F.xxhash64("rep"), count(c)).cast("int"))
    own = F.transform(numbers(c), lambda j: cell(c, F.when(i == j, no).otherwise(yes), F.least(i, j), F.greatest(i, j), F.when(i <= j, no).otherwise(yes)))
    up = F.transform(numbers(c + 1), lambda j: cell(c, F.lit(2), i, j, no))
    down = F.transform(numbers(c - 1), lambda j: cell(c - 1, F.lit(2), j, i, yes))
    cells = rows.withColumn("x", F.explode(F.concat(own, up, down))).select("key", "x.*", "rep", "n", "component", "bits")

    def compare(rep, n, comp, across, side, bits):
        """All pairs of one cell, or all across its two blocks."""
        split = across[0] > 0
        cut = int(np.searchsorted(side, 1)) if split else len(rep)
        right = np.arange(cut, len(rep)) if split else np.arange(len(rep))
        for at in range(0, cut, 256):
            x = np.arange(at, min(at + 256, cut))
            ok = comp[x][:, None] != comp[right][None, :]
            if not split:
                ok &= x[:, None] < right[None, :]
            ok &= 100 * np.minimum(n[x][:, None], n[right][None, :]) >= options.percent * np.maximum(n[x][:, None], n[right][None, :])
            p, q = np.nonzero(ok)
            p, q = x[p], right[q]
            for longs in (8, BITMAP_LONGS):
                far = np.concatenate([np.bitwise_count(bits[p[k : k + 65536], :longs] ^ bits[q[k : k + 65536], :longs]).sum(1, dtype=np.int64) for k in range(0, len(p), 65536)] or [np.zeros(0, dtype=np.int64)])
                near = (100 + options.percent) * far <= (100 - options.percent) * (n[p] + n[q])
                p, q = p[near], q[near]
            if len(p):
                yield rep[p], rep[q]

    def run(batches):
        held = None
        kind = None

        def whole(t: pa.Table):
            rep = t["rep"].to_numpy()
            bits = np.asarray(t["bits"].combine_chunks().flatten()).view(np.uint64).reshape(-1, BITMAP_LONGS)
            for a, b in compare(rep, t["n"].to_numpy(), t["component"].to_numpy(), t["across"].to_numpy(), t["side"].to_numpy(), bits):
                swap = a > b
                yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a), type=kind), pa.array(np.where(swap, a, b), type=kind)], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            kind = t["rep"].type
            t = pa.concat_tables([held, t]) if held is not None else t
            marks = [t[name].to_numpy() for name in order]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            begin = 0
            for end in cuts.tolist():
                yield from whole(t.slice(begin, end - begin))
                begin = end
            held = t.slice(begin)
        if held is not None and held.num_rows:
            yield from whole(held)

    order = ["key", "c", "across", "lo", "hi"]
    return cells.repartition(partitions, *order).sortWithinPartitions(*order, "side").mapInArrow(run, f"a {key}, b {key}")


def _keys_of_classes(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, n, keys) with the common keys of a class, rarest first: keys are dealt to their owner once, and what a class adds
    is one row for each owner."""
    keys = found.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    return keys.join(classes.select(F.col("s1").alias("owner"), "rep", "n"), "owner").select("rep", "n", "keys")


def link(docs: DataFrame, options: Options = Options(), partitions: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    percent = options.percent
    n_parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    described = settle(describe(docs, options), "described")
    classes = described.filter("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sampled").alias("sampled"))
    classes = settle(classes, "classes")
    # the histogram has one row for each set size up to the largest that a boundary depends on; larger sets count as one
    sizes = classes.groupBy(F.least("n", F.lit(2 * options.largest_boundary + 1)).alias("n")).agg(F.count("*").alias("c"), F.sum("n").alias("total")).collect()
    light_up_to = boundary({r["n"]: r["c"] for r in sizes}, options, others_met(classes))
    total_keys = sum(r["total"] for r in sizes) * (1.25 - percent / 100)
    buckets = max(8 * n_parts, int(total_keys / options.bucket_keys) + 1)
    parts = max(n_parts, buckets // 64)
    packed = settle(_packed_keys(docs, light_up_to, buckets, options), "packed-keys")
    found = settle(_common_keys(packed, parts, options), "common-keys")
    drop(packed)
    # step 2: enough common keys, then the rarest of them (a light set needs one subset alone)
    need = F.when(F.col("n") <= light_up_to, F.lit(1)).otherwise(
        F.floor(F.ceil(F.ceil(F.col("n") * percent / 100) * percent / 100) / 4) + 1
    )
    grouped = _keys_of_classes(found, classes)
    grouped = grouped.withColumn("need", need).filter(F.size("keys") >= F.col("need"))
    held = grouped.select("rep", "n", F.explode(F.slice("keys", F.lit(1), (F.size("keys") - F.col("need") + 1).cast("int"))["key"]).alias("key"))
    held = settle(held, "held")
    # lists of the same classes are one list; a list of one class leads nowhere
    marks = held.groupBy("key").agg(F.count("*").alias("m"), *[F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"x{k}") for k in (1, 2)])
    marks = settle(marks.filter("m > 1"), "list-marks")
    unlike = settle(marks.groupBy("m", "x1", "x2").agg(F.min("key").alias("key")).select("key", "m"), "unlike-lists")
    hot = hot_keys(marks, "key")
    lists = settle(by_key(held, unlike, hot, "key").select("key", "rep", "n").withColumn("c", size_class(F.col("n"), percent)), "lists")
    drop(found, held)
    # step 3: one comparison for each class
    first = settle(lists.groupBy("key").agg(F.min("rep").alias("a")), "first-of-list")
    votes = by_key(lists, first, hot, "key").filter("a < rep").groupBy("rep", "a").agg(F.count("*").alias("v"))
    pairs = votes.groupBy("rep").agg(F.max_by("a", F.struct("v", F.expr("-a") if _numeric(docs) else F.col("a"))).alias("a")).select("a", F.col("rep").alias("b"))
    pairs = settle(pairs, "pairs")
    wanted = settle(lists.select("rep").distinct(), "wanted")
    source = _picked(docs.select("doc_id", "text"), "doc_id", wanted, "rep")
    sets = settle(_with_sets(source, options).dropDuplicates(["rep"]), "sets")
    edges = settle(_verified(pairs, sets, options), "edges")
    comp = settle(components(edges), "components")
    # step 4: lists that hold more than one component
    named = lists.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = settle(named, "named-lists")
    # one row for each list: how many blocks each of its size classes has (there are few classes)
    sizes = named.groupBy("key", "c").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
    blocks = F.map_from_entries(F.collect_list(F.struct("c", F.ceil(F.col("m") / options.block).cast("int"))))
    mixed = sizes.groupBy("key").agg(blocks.alias("blocks"), F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("key", "blocks")
    rest = by_key(named, settle(mixed, "mixed-lists"), hot, "key").join(sets.select("rep", "bits"), "rep")
    more = _near_pairs(rest, n_parts, options).distinct()
    more = more.join(pairs, ["a", "b"], "left_anti")
    edges = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(settle(_verified(settle(more, "more-pairs"), sets, options), "more-edges"))
    comp = settle(components(edges), "components")
    of_class = classes.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    of_class = settle(of_class, "class-components")
    drop(sets, lists, named)
    return described.join(of_class, ["s1", "s2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _numeric(docs: DataFrame) -> bool:
    return docs.schema["doc_id"].dataType.typeName() in ("integer", "long", "short", "byte")


def keep_first(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """One document of each component (the smallest id), with the columns that came in."""
    linked = link(docs, options)
    others = settle(linked.filter("doc_id <> component_id").select("doc_id").distinct(), "not-kept")
    return docs.join(others, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, CASE WHEN trim(t, c) = '' THEN [] ELSE regexp_split_to_array(trim(t, c), '[ \t-\r]+') END AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS c FROM documents)
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM w WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), e AS MATERIALIZED (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) c
  JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * o >= 75 * (x.n + y.n - o)
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
