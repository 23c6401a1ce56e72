"""Connected components and linking inside buckets, DataFrame operations only.

Nothing here reaches the driver but row counts, and every table is removed once nothing needs it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrelake.llm.common import drop_written, maybe_broadcast, release_shuffles, written


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for every vertex of ``edges`` (a, b); component is the smallest id reachable.

    Rounds of hooking and contraction: each vertex points to its smallest neighbour, the pointers are doubled, and edges are rewritten to where
    they point. As pointers only go down inside a component, its smallest vertex is what stays. Labels follow the pointers
    of all rounds at the end, which are few. Empty edges give an empty result; loops are kept as single vertices.
    """
    first = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    hops: list[DataFrame] = []
    held, open_ = [], first.where("a <> b")
    while not open_.isEmpty():
        both = open_.union(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p"))
        jumped = parent.join(parent.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p"))
        to = written(jumped, "jumped")
        hops.append(to)
        ends = [to.select(F.col("v").alias(c), F.col("p").alias(f"r{c}")) for c in "ab"]
        left = open_.join(ends[0], "a").join(ends[1], "b").where("ra <> rb")
        open_ = written(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        held.append(open_)
    labels = first.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    for to in hops:
        labels = labels.join(to.select(F.col("v").alias("component"), F.col("p").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    labels = written(labels, "labels")
    drop_written(first, *hops, *held)
    return labels


def joined_components(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after more ``links`` (a, b) between vertices, those of ``label`` or new ones: only the components
    that a link touches are looked at again."""
    own = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    met = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = connected_components(met)
    moved = label.join(over.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    fresh = over.join(label, "id", "left_anti").select("id", "component")
    out = written(moved.unionByName(fresh), "labels")
    drop_written(over)
    return out


def link_buckets(keyed: DataFrame, verify: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame], rounds: int = 1) -> DataFrame:
    """Components (id, component) over the links between ids that share a bucket.

    ``keyed`` has rows (key, id); ``verify`` maps distinct candidate pairs (a, b), a < b, to a written table of those that are links.
    First every member is tried against its bucket's smallest one, which is linear in the bucket. Then only buckets
    that still hold several components are looked at: for some rounds, members outside the bucket's largest component are tried
    against one of them, so that a second family in a bucket costs its size too. ``rest`` gets what is left, rows (key, id,
    component, main, n) of buckets with several components, and returns the links between them as a written table.
    """
    sizes = written(keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo <> hi"), "buckets")
    many = written(sizes.where("n > 2").select("key", "lo"), "many")
    release_shuffles(keyed.sparkSession)
    members = written(keyed.join(maybe_broadcast(many), "key").select("key", "lo", "id").distinct(), "members")
    # a bucket of two needs no look at its members
    star = sizes.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    tried = written(star.union(members.where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b"))).distinct(), "star")
    drop_written(sizes, many)
    release_shuffles(keyed.sparkSession)
    done = [tried]
    links = [verify(tried)]
    label = connected_components(links[0])
    for turn in range(rounds + 1):
        named = members.join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        per = named.groupBy("key", "component").agg(F.count("*").alias("n"))
        main = per.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1")
        main = written(main.select("key", "n", F.col("top.component").alias("main")), "main")
        open_ = written(named.join(maybe_broadcast(main), "key"), "open")
        drop_written(main)
        if open_.isEmpty():
            drop_written(open_)
            break
        if turn == rounds:
            more = rest(open_)
        else:
            outside = open_.where("component <> main").select("key", F.col("id").alias("x"))
            order = F.struct(F.xxhash64("x", F.lit(turn)).alias("h"), F.col("x").alias("y"))
            pairs = outside.join(outside.groupBy("key").agg(F.min(order).alias("c")).select("key", F.col("c.y").alias("y")), "key").where("x <> y")
            pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            for before in done:
                pairs = pairs.join(before, ["a", "b"], "left_anti")
            done.append(written(pairs, "pairs"))
            more = verify(done[-1])
        drop_written(open_)
        if more.isEmpty():
            drop_written(more)
            continue
        links.append(more)
        before, label = label, joined_components(label, more)
        drop_written(before)
    drop_written(members, *done, *links)
    return label


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows (key, id) whose key occurs with another id too."""
    busy = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    return keyed.join(maybe_broadcast(written(busy, "busy")), "key", "left_semi")
