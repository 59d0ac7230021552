"""Connected components as tables: union-find by alternating large and small stars, natively."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import release, sweep, written


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b) with b < a. A large star ties the larger neighbours of each node to its least neighbour,
    a small star the smaller ones and the node itself. Least neighbours are pre-aggregated before the shuffle, and the
    join back to a hub's edges is one that Spark splits."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        tied = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return tied.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge in (a, b); root is the least node that edges lead to.

    Steps double the reach, so their number follows the logarithm of the longest path; each is written to the shared
    folder, and a count and a hash of the edges tell when nothing changes any more. Only those two numbers reach the
    driver.
    """
    now, state = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "stars"), None
    while True:
        before, now = now, written(stars(stars(now, True), False), "stars")
        release(before)
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == state or not new[0]:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


#: Members of a bucket that a task compares with as many others.
BLOCK = 500


def starred(members: DataFrame, labels: DataFrame | None, used: DataFrame | None, turn: int) -> DataFrame:
    """members of buckets with several roots, with their root and the bucket's hub, its member with most links. Those
    that were hubs of a bucket (used: bucket, node) were compared with all others there and are left out."""
    if used is not None:
        members = members.join(used, ["bucket", "node"], "left_anti")
    if labels is None:
        labelled = members.withColumns({"root": F.col("node"), "degree": F.lit(0).cast("long")})
    else:
        labelled = members.join(labels, "node", "left").withColumns({"root": F.coalesce("root", "node"), "degree": F.coalesce("degree", F.lit(0))})
    labelled = labelled.withColumn("key", F.shiftleft("degree", 24) + F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 24)))
    mixed = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held"), F.max_by("node", "key").alias("hub"), F.max_by("root", "key").alias("hub_root")).filter("low <> high")
    return labelled.select(*members.columns, "root").join(mixed.drop("low", "high"), "bucket")


def blocks(open_: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Two copies of the members of open buckets, each two of which meet once in some (bucket, i, j), in order of i and
    j. A large bucket is cut into blocks, and each two blocks meet apart, so that no task has all of its pairs."""
    parts = open_.withColumn("parts", F.ceil(F.col("held") / size).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")).drop("hub", "hub_root", "held")
    first = parts.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("parts") - 1)))
    second = parts.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), "own")))
    return first.drop("own", "parts"), second.drop("own", "parts")


def resolved(members: DataFrame, verify: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame], turns: int = 2) -> DataFrame:
    """(node, root) of every node with a link, among members (bucket, node and what ``finish`` reads).

    ``verify`` takes pairs (a, b) and gives those that are links. In each turn the members of a bucket with several
    roots are checked against one hub, the member with most links so far: that joins most of a group by as many pairs as
    it has members. Then ``finish`` gives the links among all pairs of a bucket that still cross roots, so in the end
    every link that a bucket proposes is inside a component."""
    tested = linked = labels = used = None
    roots, done, turn = None, [], 0
    while True:
        open_ = written(starred(members, labels, used, turn), "open")
        done.append(open_)
        if open_.isEmpty():
            break
        if turn < turns:
            pairs = open_.filter("root <> hub_root").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = written(pairs, "pairs")
            sweep(members.sparkSession)
            done.append(pairs)
            tested = pairs if tested is None else tested.unionByName(pairs)
            hubs = open_.select("bucket", F.col("hub").alias("node")).distinct()
            used = hubs if used is None else used.unionByName(hubs).distinct()
        found = written(verify(pairs) if turn < turns else finish(open_), "links")
        done.append(found)
        none = found.isEmpty()
        if not none:
            linked = found if linked is None else linked.unionByName(found)
            roots = components(linked)
        if turn >= turns:
            break
        if not none:
            both = linked.select(F.col("a").alias("node")).unionByName(linked.select(F.col("b").alias("node")))
            labels = roots.join(both.groupBy("node").agg(F.count("*").alias("degree")), "node")
        turn = turns if none else turn + 1
    if roots is None:
        roots = components(members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    release(*done)
    return roots
