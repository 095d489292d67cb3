"""Edit-distance join of names by anagram keys.

A name's key is the multiset of its letters, written in sorted order; exchanging letters doesn't change it. Each name
gives its own key and those with up to `most` letters taken out. Names at a distance of d differ by at most d letters on
each side, so two names within `most` edits share a key: an equi-join finds every pair. A pair is taken at one key
alone, the greatest that both hold, which is where the letters taken out on one side have none in common with those of
the other; so nothing has to be made distinct. The order of letters is then verified by a bit-parallel distance.

Distance is unrestricted Damerau-Levenshtein over code points. The bit vectors give the restricted distance (no
substring is edited twice); both agree up to 2, and beyond that, where `most` asks for it, a table of the pair decides.

Names are joined once each, however many rows have them. A key that many different names share (a part of all keyed
rows beyond one in `joins.HOT_KEYS`) is taken apart by the same keys of the names' first halves: a fixed-length start of
two names differs by no more letters than the names have edits between them.

Defined results: null and empty names join nothing; repeated names are one name; a very long name gives as many keys as
it has different letters, and one, for each letter that may be taken out (keys longer than 64 letters are hashed);
ties don't occur; empty tables give an empty result. `match_names` reads the column `name` alone, so further columns of
the inputs, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.joins import hot_keys
from corpusloom.runtime import settle, ship, table

#: Letters of a key that is written out; longer ones are hashed.
KEY_LETTERS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(name: Column) -> Column:
    """A-Z lower-cased, ASCII white space removed."""
    return F.regexp_replace(F.translate(name, UPPER, LOWER), r"[ \t-\r]+", "")


def _one_less(entry: Column) -> Column:
    """Every multiset that comes of taking out one letter at or after the last one taken; equal letters count once."""
    letters, at = entry["letters"], entry["at"]
    places = F.filter(F.sequence(at, F.size(letters) - 1), lambda i: (i == at) | (F.get(letters, i) != F.get(letters, i - 1)))
    taken = F.transform(
        places,
        lambda i: F.struct(
            F.concat(F.slice(letters, F.lit(1), i), F.slice(letters, i + 2, F.size(letters))).alias("letters"),
            i.alias("at"),
            F.concat(entry["gone"], F.array(F.get(letters, i))).alias("gone"),
        ),
    )
    return F.when(at < F.size(letters), taken).otherwise(F.filter(taken, lambda x: F.lit(False)))


def with_keys(names: DataFrame, text: str, most: int, key: str = "key", gone: str = "gone") -> DataFrame:
    """Add a row for each key of a text: the key and the letters that were taken out for it."""
    letters = F.filter(F.split(F.col(text), ""), lambda x: x != "")  # an empty text has none
    whole = F.struct(F.array_sort(letters).alias("letters"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("gone"))
    d = names.withColumn("_level0", F.array(whole))
    for k in range(most):
        d = d.withColumn(f"_level{k + 1}", F.flatten(F.transform(f"_level{k}", _one_less)))
    levels = [f"_level{k}" for k in range(most + 1)]
    d = d.withColumn("_entry", F.explode(F.concat(*levels)))
    joined = F.array_join("_entry.letters", "")
    written = F.when(F.size("_entry.letters") <= KEY_LETTERS, joined).otherwise(F.sha2(joined.cast("binary"), 256))
    return d.select(*names.columns, written.alias(key), F.col("_entry.gone").alias(gone))


def _bit_parallel(equal: Iterable, length, last, full, one):
    """Restricted distance by bit vectors: equal(j) has a bit for each letter of the first text that equals letter j of
    the second. Works on Python integers as on arrays of 64-bit words, one pair each."""
    zero = one ^ one
    up, down, before, diagonal, distance = full, zero, zero, zero, length
    for here, going in equal:
        swapped = (((~diagonal & full) & here) << one) & before
        diagonal = ((((here & up) + up) & full) ^ up) | here | down | swapped
        plus, minus = down | (~(diagonal | up) & full), diagonal & up
        distance = distance + going * ((plus & last) != zero) - going * ((minus & last) != zero)
        plus, minus = ((plus << one) | one) & full, (minus << one) & full
        up, down, before = minus | (~(diagonal | plus) & full), plus & diagonal, here
    return distance


def _short(a: list[str], b: list[str]) -> np.ndarray:
    """Of pairs of texts with 1 to 64 letters each."""

    def codes(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32) for x in texts]
        sizes = np.array([len(x) for x in rows])
        out = np.full((len(rows), sizes.max()), fill, dtype=np.int64)
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(rows)
        return out, sizes

    (p, m), (t, n) = codes(a, -1), codes(b, -2)
    one = np.uint64(1)
    bits = one << np.arange(p.shape[1], dtype=np.uint64)
    steps = (((p == t[:, j : j + 1]) @ bits, (j < n).astype(np.int64)) for j in range(t.shape[1]))
    full = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    return _bit_parallel(steps, m.astype(np.int64), one << (m - 1).astype(np.uint64), full, one)


def _long(a: str, b: str) -> int:
    """Of one pair of texts of any length."""
    if not a or not b:
        return max(len(a), len(b))
    has: dict[str, int] = {}
    for i, x in enumerate(a):
        has[x] = has.get(x, 0) | 1 << i
    return int(_bit_parallel(((has.get(x, 0), 1) for x in b), len(a), 1 << len(a) - 1, (1 << len(a)) - 1, 1))


def _table(a: str, b: str) -> int:
    """Unrestricted distance of one pair: an exchange may span letters that are put in or taken out between."""
    far = len(a) + len(b)
    cost = {(-1, j): far for j in range(-1, len(b) + 1)} | {(i, -1): far for i in range(len(a) + 1)}
    cost |= {(0, j): j for j in range(len(b) + 1)} | {(i, 0): i for i in range(len(a) + 1)}
    seen: dict[str, int] = {}
    for i in range(1, len(a) + 1):
        met = 0
        for j in range(1, len(b) + 1):
            row, column = seen.get(b[j - 1], 0), met
            same = a[i - 1] == b[j - 1]
            if same:
                met = j
            exchange = cost[row - 1, column - 1] + (i - row - 1) + 1 + (j - column - 1) if row and column else far
            cost[i, j] = min(cost[i - 1, j - 1] + (not same), cost[i - 1, j] + 1, cost[i, j - 1] + 1, exchange)
        seen[a[i - 1]] = i
    return cost[len(a), len(b)]


def distances(a: list[str], b: list[str], most: int) -> np.ndarray:
    """The distance of each pair, exact where it is at most `most`, else some number above it."""
    out = np.zeros(len(a), dtype=np.int64)
    short = np.array([0 < len(x) <= 64 and 0 < len(y) <= 64 for x, y in zip(a, b, strict=True)], dtype=bool)
    if short.any():
        at = np.flatnonzero(short)
        out[at] = _short([a[i] for i in at], [b[i] for i in at])
    for i in np.flatnonzero(~short):
        out[i] = _long(a[i], b[i])
    if most > 1:
        for i in np.flatnonzero(out > 2):
            out[i] = _table(a[i], b[i])
    return out


def _distance(a: Column, b: Column, most: int) -> Column:
    @F.pandas_udf("int")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(distances(a.tolist(), b.tolist(), most), dtype="int32")

    return of(a, b)


def _meet(left: DataFrame, right: DataFrame, on: list[str], *gone: str) -> DataFrame:
    """Rows of equal keys whose letters taken out have none in common, for each of the named columns."""
    d = left.join(right, on)
    for name in gone:
        d = d.filter(~F.arrays_overlap("left_" + name, "right_" + name))
    return d


def match_names(left: DataFrame, right: DataFrame, most: int = 1) -> DataFrame:
    """(left_name, right_name, distance) for every two different or equal names of both tables within `most` edits."""
    ship(left.sparkSession)

    def keyed(df: DataFrame, side: str) -> DataFrame:
        names = df.select(F.col("name").alias(f"{side}_name")).filter(F.col(f"{side}_name") != "").distinct()
        return with_keys(names, f"{side}_name", most, "key", f"{side}_gone")

    a, b = keyed(left, "left"), keyed(right, "right")
    hot = hot_keys(a.select("key").unionByName(b.select("key")).groupBy("key").agg(F.count("*").alias("m")), "key")
    if hot is None:
        pairs = _meet(a, b, ["key"], "gone")
    else:
        few = F.broadcast(hot)
        pairs = _meet(a.join(few, "key", "left_anti"), b.join(few, "key", "left_anti"), ["key"], "gone").select("left_name", "right_name")

        def halves(df: DataFrame, side: str) -> DataFrame:
            shared = F.char_length(f"{side}_name") - F.size(f"{side}_gone")
            d = df.join(few, "key", "left_semi").withColumn(f"{side}_start", F.left(F.col(f"{side}_name"), F.floor(shared / 2).cast("int")))
            return with_keys(d, f"{side}_start", most, "start_key", f"{side}_start_gone").drop(f"{side}_start")

        pairs = pairs.unionByName(_meet(halves(a, "left"), halves(b, "right"), ["key", "start_key"], "gone", "start_gone").select("left_name", "right_name"))
    pairs = pairs.select("left_name", "right_name", _distance(F.col("left_name"), F.col("right_name"), most).alias("distance"))
    return pairs.filter(F.col("distance") <= most)


def _misspelt(name: Column, vendor_id: Column) -> Column:
    """The name as the contract of the query misspells it: of an even crc32 h, letters h mod (length - 1) and the next change places."""
    h, n = F.crc32(vendor_id.cast("string").cast("binary")), F.char_length(name)
    at = (h % F.greatest(n - 1, F.lit(1))).cast("int")
    swapped = F.concat(F.left(name, at), F.substring(name, at + 2, F.lit(1)), F.substring(name, at + 1, F.lit(1)), F.substring(name, at + 3, n))
    return F.when((h % 2 == 0) & (n >= 2), swapped).otherwise(name)


def query(spark, sf_dir: str) -> DataFrame:
    clients = table(spark, sf_dir, "clients").select("client_id", normal(F.col("name")).alias("name")).filter("name <> ''")
    clients = settle(
        clients.groupBy("name").agg(
            F.count("*").alias("n"), F.min("client_id").alias("first"), F.sum(F.crc32(F.col("client_id").cast("string").cast("binary"))).alias("crc")
        ),
        "client-names",
    )
    vendors = table(spark, sf_dir, "vendors").select("vendor_id", normal(_misspelt(F.col("name"), F.col("vendor_id"))).alias("name")).filter("name <> ''")
    pairs = match_names(vendors, clients).withColumnRenamed("right_name", "name")
    sums = (
        pairs.join(clients, "name")
        .groupBy("left_name", "distance")
        .agg(F.sum("n").alias("n_clients"), F.min("first").alias("first_client_id"), F.sum("crc").alias("clients_crc"))
        .withColumnRenamed("left_name", "name")
    )
    return vendors.join(sums, "name").select("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc")


def _crc32(text: str) -> str:
    """crc32 of an ASCII text in DuckDB: bit by bit over the bytes."""
    byte = "list_reduce(list_prepend(xor(s, x), range(8)::BIGINT[]), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda s, x: {byte}))"


_NORMAL = rf"regexp_replace(translate({{}}, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', '', 'g')"
ORACLE_SQL = rf"""
WITH c AS MATERIALIZED (
  SELECT {_NORMAL.format('name')} AS name, count(*) AS n, min(client_id) AS first, sum({_crc32('client_id::VARCHAR')}) AS crc
  FROM clients WHERE name IS NOT NULL GROUP BY ALL),
h AS (SELECT vendor_id, name, length(name) AS l, {_crc32('vendor_id::VARCHAR')} AS h FROM vendors WHERE name IS NOT NULL),
p AS (SELECT *, CASE WHEN l >= 2 AND h % 2 = 0 THEN h % (l - 1) END AS k FROM h),
v AS MATERIALIZED (SELECT vendor_id, {_NORMAL.format("CASE WHEN k IS NULL THEN name ELSE name[:k] || name[k + 2] || name[k + 1] || name[k + 3:] END")} AS name FROM p),
vn AS MATERIALIZED (SELECT DISTINCT name FROM v WHERE name <> ''),
cn AS MATERIALIZED (SELECT name FROM c WHERE name <> ''),
vi AS (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM vn), ci AS (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM cn),
vd AS MATERIALIZED (SELECT name, i, name[:i - 1] || name[i + 1:] AS rest FROM vi), cd AS MATERIALIZED (SELECT name, i, name[:i - 1] || name[i + 1:] AS rest FROM ci),
pairs AS (
  SELECT vn.name AS v, cn.name AS c, 0 AS distance FROM vn JOIN cn USING (name)
  UNION ALL SELECT DISTINCT * FROM (
    SELECT vd.name, cn.name, 1 FROM vd JOIN cn ON cn.name = vd.rest
    UNION ALL SELECT vn.name, cd.name, 1 FROM cd JOIN vn ON vn.name = cd.rest
    UNION ALL SELECT vd.name, cd.name, 1 FROM vd JOIN cd USING (i, rest) WHERE vd.name <> cd.name
    UNION ALL SELECT vi.name, cn.name, 1 FROM vi JOIN cn ON cn.name = vi.name[:i - 1] || vi.name[i + 1] || vi.name[i] || vi.name[i + 2:] WHERE i < length(vi.name) AND cn.name <> vi.name))
SELECT vendor_id, distance, sum(n)::BIGINT AS n_clients, min(first) AS first_client_id, sum(crc)::BIGINT AS clients_crc
FROM v JOIN pairs ON pairs.v = v.name JOIN c ON c.name = pairs.c GROUP BY ALL
"""
