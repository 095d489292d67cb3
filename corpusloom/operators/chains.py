"""Markov chains on edge tables of any size: components, and the distribution that a chain settles at.

A chain is a table of edges (i, j, w), a walker at i going to j in proportion to w; edges of the same ends add up. Each step is one join of
the edges with the present shares and one sum by target, which is pre-aggregated, so a node that a third of all edges lead
to is summed up before it is shuffled. Up to BROADCAST_NODES nodes the shares are broadcast and edges aren't shuffled in a step; above,
edges of a hot source meet one row, and Spark splits such a join. Steps are written to
the shared folder, a few at a time, so lineage stays short and a lost executor costs few steps.

Defined results: edges with a null end, and of null, zero or negative weight are left out; nodes without edges exist where a table of nodes names
them; an empty graph gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.runtime import drop, settle, ship


@dataclass(frozen=True)
class Options:
    """damping: None for the bare chain, else the share of steps along edges. lost: what becomes of the share at a node
    that nothing leads out of: `stay`, `leave` (it goes) or, with damping, `jump` (it is spread as jumps are). steps: the
    most; a chain that swings for ever ends there. rtol, atol: the change at which a share counts as settled. squares: square
    the chain after each step, so that k steps go as far as 2^k, for small or sparse chains: squares fill up.
    unroll: steps in one job, between two tests."""

    damping: float | None = None
    lost: str = "stay"
    steps: int = 1_000
    rtol: float = 1e-5
    atol: float = 1e-8
    squares: bool = False
    unroll: int = 8

    def __post_init__(self):
        if self.lost not in ("stay", "leave", "jump") or (self.lost == "jump" and self.damping is None):
            raise ValueError("lost is stay, leave, or, with damping, jump")
        if self.squares and self.damping is not None:
            raise ValueError("only the bare chain is squared")


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j", F.col("w").cast("double").alias("w")).filter("i IS NOT NULL AND j IS NOT NULL AND w > 0")


#: Edges up to which what is left of a graph is joined up in one go: a few MB.
REST_EDGES = 100_000


def _roots(rest: DataFrame) -> DataFrame:
    """(from, to): each end of at most REST_EDGES edges (u, v) with the first end of its component."""
    kind = rest.schema["u"].dataType.simpleString()

    def run(batches):
        up: dict = {}
        names = None

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            names = batch.column(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, v = root(u), root(v)
                up[max(u, v)] = min(u, v)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), type=names), pa.array([root(x) for x in list(up)], type=names)], names=["from", "to"])

    return rest.coalesce(1).mapInArrow(run, f"`from` {kind}, `to` {kind}")


def components(edges: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """(node, component) of every end of the edges, directions aside; a component is named by its smallest node.

    Rounds of contraction: by a hash that changes with the round, a node that comes before all its neighbours is a centre, and each
    other node joins the first centre among its neighbours; edges are then drawn between what is left. A constant share of
    the nodes goes in a round, on paths and stars alike, so rounds grow with the logarithm of the nodes. Once at most REST_EDGES
    edges are left, one round joins them all up."""
    ship(edges.sparkSession)
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    order = lambda c, turn: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("x"))
    ordered = lambda d: d.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    e = settle(ordered(ends), "contract")
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node"))
    turn, moves = 0, []
    while left := e.count():
        if left <= REST_EDGES:
            nodes = nodes.join(settle(_roots(e), "moves"), F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
            break
        turn += 1
        both = e.union(e.select("v", "u"))
        first = both.groupBy("u").agg(F.min(order("v", turn)).alias("v"))
        centres = first.filter(order("u", turn) < F.col("v")).select(F.col("u").alias("centre"))
        to = both.join(centres, F.col("v") == F.col("centre")).groupBy("u").agg(F.min(order("v", turn)).alias("v"))
        to = settle(to.select(F.col("u").alias("from"), F.col("v.x").alias("to")), "moves")
        moved = e.join(to, F.col("u") == F.col("from"), "left").select(F.coalesce("to", "u").alias("u"), "v")
        moved = moved.join(to, F.col("v") == F.col("from"), "left").select("u", F.coalesce("to", "v").alias("v"))
        left = settle(ordered(moved), "contract")
        nodes = nodes.join(to, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
        drop(e)
        e = left
        moves.append(to)
        if len(moves) % 4 == 0:
            nodes = settle(nodes, "nodes")
            drop(*moves[-4:])
    nodes = settle(nodes, "nodes")
    names = nodes.groupBy("root").agg(F.min("node").alias("component"))
    return nodes.join(names, "root").select("node", "component")


#: Nodes up to which the shares of a step are broadcast to the edges, which then stay where they lie: about 50 MB.
BROADCAST_NODES = 500_000


def transitions(edges: DataFrame) -> DataFrame:
    """(i, j, p): the chance of each step; those of a node sum to 1."""
    e = settle(_clean(edges).groupBy("i", "j").agg(F.sum("w").alias("w")), "chain-edges")
    return e.join(e.groupBy("i").agg(F.sum("w").alias("total")), "i").select("i", "j", (F.col("w") / F.col("total")).alias("p"))


def _squared(p: DataFrame) -> DataFrame:
    """Two steps as one: a join on the node between and a sum."""
    second = p.select(F.col("i").alias("m"), F.col("j").alias("k"), F.col("p").alias("q"))
    return p.join(second, p["j"] == second["m"]).groupBy("i", "k").agg(F.sum(F.col("p") * F.col("q")).alias("p")).select("i", F.col("k").alias("j"), "p")


def stationary(edges: DataFrame, options: Options = Options(), nodes: DataFrame | None = None, bias: DataFrame | None = None, normalized: bool = True) -> DataFrame:
    """(node, share): where the chain settles when each node starts with the share 1, by repeated steps; shares of a component
    sum to its nodes' number, and so to 1 over all nodes if `normalized` divides by that number. Of a chain with
    transient or absorbing states it is the limit from that start. With damping, jumps lead to nodes in proportion to
    `bias` (node, share), else evenly."""
    p = transitions(edges)
    names = p.select(F.explode(F.array("i", "j")).alias("node"))
    names = names if nodes is None else names.unionByName(nodes.select("node").filter("node IS NOT NULL"))
    names = settle(names.distinct(), "chain-nodes")
    n = names.count()
    if options.lost == "stay":
        out = p.select("i").distinct()
        p = p.unionByName(names.join(out, names["node"] == out["i"], "left_anti").select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("p")))
    few = n <= BROADCAST_NODES
    # edges are dealt out by target once: with shares broadcast to them, a step shuffles about one partial sum for each node
    p = settle(p.repartition("j") if few else p, "chain")
    base = names.withColumns({"x": F.lit(1.0), "jump": F.lit(1.0), "dead": F.lit(False)})
    if options.damping is not None:
        dead = names.join(p.select(F.col("i").alias("node")).distinct(), "node", "left_anti").withColumn("d", F.lit(True))
        base = names.join(dead, "node", "left").select("node", F.lit(1.0).alias("x"), F.lit(1.0).alias("jump"), F.coalesce("d", F.lit(False)).alias("dead"))
        if bias is not None:
            some = bias.filter("node IS NOT NULL AND share > 0").groupBy("node").agg(F.sum("share").alias("b"))
            total = some.join(names, "node", "left_semi").agg(F.sum("b")).first()[0]
            if total:
                base = base.join(some, "node", "left").select("node", "x", (F.coalesce("b", F.lit(0.0)) * n / total).alias("jump"), "dead")
    v = settle(base, "shares")

    def step(v: DataFrame, lost: float) -> DataFrame:
        """x of the next turn; `old` is what it was."""
        now = v.select(F.col("node").alias("i"), "x")
        came = p.join(F.broadcast(now) if few else now, "i").groupBy("j").agg(F.sum(F.col("p") * F.col("x")).alias("came"))
        new = F.coalesce("came", F.lit(0.0))
        if options.damping is not None:
            new = options.damping * (new + F.lit(lost) / max(n, 1) * F.col("jump")) + (1 - options.damping) * F.col("jump")
        d = v.join(came, F.col("node") == F.col("j"), "left")
        return d.select("node", new.alias("x"), "jump", "dead", F.col("x").alias("old"))

    # what dead ends hold is known when a step begins, or there is none, and then several steps make one job
    watch = options.lost == "jump" and not base.filter("dead").isEmpty()
    per_job = 1 if options.squares or watch else max(1, options.unroll)
    done = 0
    while n and done < options.steps:
        lost = (v.agg(F.sum(F.when(F.col("dead"), F.col("x")))).first()[0] or 0.0) if watch else 0.0
        now = v
        turns = min(per_job, options.steps - done)
        for _ in range(turns):
            now = step(now, lost)
        now, before = settle(now, "shares"), v
        done += turns
        still = F.abs(F.col("x") - F.col("old")) > options.atol + options.rtol * F.abs(F.col("old"))
        v = now
        drop(before)
        if not now.agg(F.max(still)).first()[0]:
            break
        if options.squares:
            older, p = p, settle(_squared(p), "chain")
            drop(older)
    scale = n if normalized and n else 1
    return v.select("node", (F.col("x") / F.lit(float(scale))).alias("share"))
