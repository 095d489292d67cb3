import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import joins, name_join as N


def brute(a, b):
    """Unrestricted distance by shortest paths over the cells of both texts (breadth-first relaxation until nothing changes)."""
    cost = {(i, j): max(len(a), len(b)) * 2 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    cost[0, 0] = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            steps = [(i + 1, j, 1), (i, j + 1, 1)]
            if i < len(a) and j < len(b):
                steps.append((i + 1, j + 1, a[i] != b[j]))
                # exchange: a[i] meets a later letter of b, b[j] a later letter of a, all between is taken out or put in (six at most)
                steps += [(x + 1, y + 1, (x - i - 1) + 1 + (y - j - 1)) for x in range(i + 1, min(len(a), i + 7)) for y in range(j + 1, min(len(b), j + 7)) if a[i] == b[y] and a[x] == b[j]]
            for x, y, c in steps:
                if (x, y) in cost:
                    cost[x, y] = min(cost[x, y], cost[i, j] + c)
    return cost[len(a), len(b)]


def words(seed, n, letters="abcé😀", low=0, high=6):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(low, high))) for _ in range(n)]


def test_distances_against_brute_force():
    assert brute("ca", "abc") == 2 and brute("ab", "ba") == 1
    a, b = words(1, 1500), words(2, 1500)
    long = ["x" * 70 + "ab" + "y" * 30, "ab" * 40]
    a += [*long, long[0], ""]
    b += [long[0][:70] + "ba" + long[0][72:], "ab" * 39 + "ba", long[0][1:], "abc"]
    want = [brute(x, y) for x, y in zip(a, b, strict=True)]
    for most in (1, 2, 5):
        got = N.distances(a, b, most)
        assert all(g == w if w <= most else g > most for g, w in zip(got, want, strict=True)), most


@pytest.fixture(params=[False, True], ids=["plain", "hot"])
def hot(request, monkeypatch):
    """Also with every shared key taken apart by the first halves."""
    if request.param:
        monkeypatch.setattr(N, "hot_keys", lambda sizes, *keys: sizes.filter("m > 1").select(*keys))


def frame(spark, names, kind="left"):
    return spark.createDataFrame([(k, n, "k", ["a"], 1) for k, n in enumerate(names)], "id long, name string, `key` string, gone array<string>, left_name int")


@pytest.mark.parametrize("most", [0, 1, 2])
def test_pairs_against_brute_force(spark, hot, most):
    left = [*words(3, 60), "abab", "abba", None, "", "x" * 80]
    right = [*words(4, 60), "abab", "baab", None, "", "x" * 79 + "y", "x" * 80]
    want = {(x, y): brute(x, y) for x in set(left) - {None, ""} for y in set(right) - {None, ""}}
    want = sorted((x, y, d) for (x, y), d in want.items() if d <= most)
    got = sorted(map(tuple, N.match_names(frame(spark, left), frame(spark, right), most).collect()))
    assert got == want and len(got) > 5


def test_hot_keys_are_found(spark):
    names = ["".join(p) for p in {tuple(random.Random(k).sample("abcdefgh", 8)) for k in range(300)}]
    d = N.with_keys(frame(spark, names).select("name"), "name", 1, "key", "gone")
    found = joins.hot_keys(d.groupBy("key").agg(F.count("*").alias("m")), "key")
    assert found is not None and "abcdefgh" in {r[0] for r in found.collect()}
    got = {(r[0], r[1]) for r in N.match_names(frame(spark, names), frame(spark, names)).collect()}
    assert got == {(x, y) for x in names for y in names if brute(x, y) <= 1}


def test_empty_tables(spark):
    assert N.match_names(frame(spark, []), frame(spark, ["a"])).count() == 0
    assert N.match_names(frame(spark, ["a"]), frame(spark, [])).count() == 0


def test_misspelling(spark):
    import zlib

    rows = [(k, n) for k, n in enumerate(["ab", "a", "", None, "Öx y", "abcdef", "😀bc d", *words(5, 40)])]
    d = spark.createDataFrame(rows, "vendor_id long, name string")
    for r in d.select("vendor_id", "name", N._misspelt(F.col("name"), F.col("vendor_id")).alias("out")).collect():
        x, h = r.name, zlib.crc32(str(r.vendor_id).encode())
        if x is not None and h % 2 == 0 and len(x) >= 2:
            k = h % (len(x) - 1)
            x = x[:k] + x[k + 1] + x[k] + x[k + 2 :]
        assert r.out == x
