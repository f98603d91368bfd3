"""Components and cycles of large graphs, by rounds of joins over tables no larger than the graph.

Each round is written to the shared folder. Aggregates that are joined on their own key are written first, so that both
sides of the join are shuffled for it and adaptive execution can split a node with very many links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import condensed, freed, kept, merged

ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node that can be reached.

    Alternating large-star and small-star steps: each replaces the links of a node by links to its least
    neighbour, so that long chains shorten fast and no task gathers a node's neighbours. Self-links and
    repeated links are fine; null ends are ignored. Of the rounds' tables only the result is left."""
    return condensed(links.sparkSession, lambda: _components(links), "components")


def _components(links: DataFrame) -> DataFrame:
    spark = links.sparkSession
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = kept(links, "links"), None
    for _ in range(ROUNDS):
        links = condensed(spark, lambda whole=links: _shortened(whole), "links")
        with freed(spark):
            now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _shortened(links: DataFrame) -> DataFrame:
    """A large-star and a small-star step over links (a, b), a > b."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    large = both.join(merged(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = kept(large.where("a <> b").distinct(), "large")
    least = kept(large.groupBy("a").agg(F.min("b").alias("m")), "least")
    small = large.join(merged(least), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
    return small.where("a <> b").distinct()


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chains, rings) of edges (a, b) without self-loops: each node with one edge in and one out, with start and end, the nearest
    others before and after it; and the nodes of rings of such nodes alone. Pointers are doubled, so rounds grow with the logarithm of
    the longest chain."""
    out = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"), F.max("b").alias("end"))
    into = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("m"), F.max("a").alias("start"))
    inner = kept(out.join(merged(into), "node").where("n = 1 and m = 1").select("node", "start", "end"), "inner")
    n = inner.count()
    pointers = kept(inner.select("node", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("start").alias("to")), F.struct(F.lit(1).alias("way"), F.col("end").alias("to")))).alias("p")).select("node", "p.way", "p.to"), "pointers")
    open_, rounds = bool(n), max(1, n).bit_length() + 1
    for _ in range(rounds if open_ else 0):
        ahead = pointers.select("way", F.col("node").alias("to"), F.col("to").alias("far"))
        pointers = kept(pointers.join(merged(ahead), ["way", "to"], "left").select("node", "way", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "pointers")
        open_ = not pointers.where("moved").isEmpty()
        pointers = pointers.drop("moved")
        if not open_:
            break
    ends = kept(pointers.groupBy("node").agg(F.max(F.when(F.col("way") == 0, F.col("to"))).alias("start"), F.max(F.when(F.col("way") == 1, F.col("to"))).alias("end")), "ends")
    # After so many doublings a pointer that still moves is on a ring.
    rings = ends.join(merged(inner.select(F.col("node").alias("end"))), "end", "left_semi").select("node")
    rings = kept(rings, "rings")
    return kept(ends.join(merged(rings), "node", "left_anti"), "chains"), rings


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without those of nodes that nothing leads to or that lead nowhere, over and over."""
    n = edges.count()
    while n:
        edges = kept(edges.join(merged(edges.select(F.col("a").alias("b")).distinct()), "b", "left_semi").join(merged(edges.select(F.col("b").alias("a")).distinct()), "a", "left_semi").select("a", "b"), "trimmed")
        now = edges.count()
        if now == n:
            break
        n = now
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the greatest node that leads to each one. Only nodes whose colour has changed pass it on."""
    colours = kept(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("colour")), "colours")
    front = colours
    while True:
        told = edges.join(merged(front.select(F.col("node").alias("a"), "colour")), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("more"))
        front = kept(colours.join(merged(kept(told, "told")), "node").where("more > colour").select("node", F.col("more").alias("colour")), "front")
        if front.isEmpty():
            return colours
        colours = kept(colours.join(merged(front.withColumnRenamed("colour", "__new")), "node", "left").select("node", F.coalesce("__new", "colour").alias("colour")), "colours")


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node) of those nodes of edges (a, b) that lead back to themselves: strongly connected components of two nodes and more, and
    nodes with an edge to themselves. Null ends are ignored, repeated edges are one.

    Chains of nodes with one edge in and one out are one edge each, nodes in no cycle are trimmed, then components are found by colours
    passed forwards and a walk back from the node that gave a colour. Tables are linear in the edges; colours and walks take as many
    rounds as what is left by then is wide."""
    edges = kept(edges.where("a is not null and b is not null").select("a", "b").distinct(), "edges")
    found = [edges.where("a = b").select(F.col("a").alias("node"))]
    edges = kept(edges.where("a <> b"), "edges")
    chains, rings = _chains(edges)
    found.append(rings)
    gone = kept(chains.select("node").union(rings), "gone")
    off = lambda df, c: df.join(merged(gone.withColumnRenamed("node", c)), c, "left_anti")
    whole = kept(off(off(edges, "a"), "b").select("a", "b").union(chains.select(F.col("start").alias("a"), F.col("end").alias("b"))).distinct(), "kernel")
    found.append(whole.where("a = b").select(F.col("a").alias("node")))
    found.append(chains.where("start = end").select("node"))
    left, classes = _trimmed(kept(whole.where("a <> b"), "left")), []
    while not left.isEmpty():
        colours = _coloured(left)
        tones = colours.withColumnRenamed("colour", "tone")
        inside = left.join(merged(tones.withColumnRenamed("node", "a")), "a").join(merged(tones.select(F.col("node").alias("b"), F.col("tone").alias("other"))), "b").where("tone = other")
        inside = kept(inside.select("a", "b", "tone"), "inside")
        front = kept(colours.where("node = colour").select("node", F.col("colour").alias("tone")), "front")
        seen = [front]
        reached = front
        while True:
            nexts = inside.join(merged(front.withColumnRenamed("node", "b")), ["b", "tone"], "left_semi").select(F.col("a").alias("node"), "tone").distinct()
            front = kept(nexts.join(merged(reached), ["node", "tone"], "left_anti"), "front")
            if front.isEmpty():
                break
            seen.append(front)
            reached = reached.union(front)
        reached = kept(reached, "reached")
        classes.append(reached)
        done = reached.select("node")
        inside = inside.join(merged(done.withColumnRenamed("node", "a")), "a", "left_anti").join(merged(done.withColumnRenamed("node", "b")), "b", "left_anti")
        left = _trimmed(kept(inside.select("a", "b"), "left"))
    if classes:
        scc = classes[0]
        for more in classes[1:]:
            scc = scc.union(more)
        sizes = kept(scc.groupBy("tone").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        scc = kept(scc.join(merged(sizes), "tone", "left_semi"), "scc")
        found.append(scc.select("node"))
        a, b = (scc.select(F.col("node").alias(c), F.col("tone").alias(f"{c}_tone")) for c in ("start", "end"))
        found.append(chains.join(merged(a), "start").join(merged(b), "end").where("start_tone = end_tone").select("node"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()
