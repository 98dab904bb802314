"""Components of a similarity graph whose candidate pairs come from shared keys.

Members of a key's list are not paired with each other at once. First every node is compared with
one leader, that of the lists it shares most; what links shares a label from then on,
which settles groups of near copies in linear work. Then the pairs of a list whose members have
different labels are all compared, so no link between components is missed; a pair under one label
is linked already and cannot change the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage, discard, free_shuffles

BROADCAST_IDS = 1_000_000


def members_of_shared_keys(postings: Callable[[], DataFrame]) -> DataFrame:
    """(key, node, n, place) for keys that at least two nodes hold. Keys are
    counted with map-side merging; ``postings`` is cheap to compute and so computed twice."""
    shared = postings().groupBy("key").agg(F.count("*").alias("holders")).filter("holders > 1").select("key")
    return cut_lineage(postings().join(shared, "key"))


def within_broadcast(nodes: DataFrame) -> DataFrame:
    """The ids, to be broadcast by a join if they are at most ``BROADCAST_IDS``."""
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes


def enough_keys(pairs: DataFrame, num: int, den: int, single_from: int | None, share: int = 1,
                most: int = 1 << 30) -> DataFrame:
    """Pairs (u, v, nu, nv, keys) whose sizes and shared keys allow the Jaccard bound num/den. Of two
    sets that post single elements, the one whose first elements end earlier shares all but n - o of
    them, o being the overlap needed; ``share`` 2 asks for half of that, ``most`` never for more."""
    need = f"least({most}, ceil({num} * (nu + nv) / {num + den}) - ceil({num} * greatest(nu, nv) / {den}) + 1)"
    fits = pairs.filter(F.expr(f"{den} * least(nu, nv) >= {num} * greatest(nu, nv)"))
    if single_from is None:
        return fits
    return fits.filter(F.expr(f"least(nu, nv) < {single_from} or {share} * keys >= {need}"))


def verified(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(u, v): the pairs whose sets have a Jaccard similarity of num/den or more, as a table."""
    pairs = cut_lineage(pairs.select("u", "v"))
    items = sets(cut_lineage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()))
    sides = (pairs.join(items.select(F.col("node").alias("u"), F.col("items").alias("x")), "u")
             .join(items.select(F.col("node").alias("v"), F.col("items").alias("y")), "v"))
    common = sides.withColumn("common", F.size(F.array_intersect("x", "y")))
    return cut_lineage(common.filter(den * F.col("common") >= num * (F.size("x") + F.size("y") - F.col("common")))
                       .select("u", "v").distinct())


def link(members: DataFrame, sets: Callable[[DataFrame], DataFrame], num: int, den: int,
         single_from: int | None = None) -> DataFrame:
    """(node, component) of all nodes that link to another. ``members`` has (key, node, n, place):
    n is the size of the node's set, place the rank of the key's last element in the order
    all sets share (0 where there is none). ``sets`` gives (node, items) of a table of nodes. Sets of
    ``single_from`` elements or more have posted their first elements one by one. With a column odd, whose 64
    bits tell which buckets hold an odd number of the set's elements, pairs are dropped that differ in more
    buckets than similar sets have elements of one only; this is exact."""
    odd = ["odd"] if "odd" in members.columns else []

    def near(n: str, m: str, x: str, y: str) -> str:
        return f"bit_count({x} ^ {y}) <= {n} + {m} - 2 * ceil({num} * ({n} + {m}) / {num + den})" if odd else "true"

    # the node that shares most leads a list: of near copies the one that is changed least
    shared = members.groupBy("node").agg(F.count("*").alias("shares"))
    lead = (members.join(shared, "node").groupBy("key")
            .agg(F.max(F.struct("shares", (-F.col("node")).alias("back"), "n", *odd)).alias("lead")))
    met = (members.join(lead, "key").filter(near("lead.n", "n", "lead.odd", "odd"))
           .select((-F.col("lead.back")).alias("u"), F.col("lead.n").alias("nu"), F.col("node").alias("v"), F.col("n").alias("nv"))
           .filter("u <> v").groupBy("u", "v", "nu", "nv").agg(F.count("*").alias("keys")))
    best = Window.partitionBy("v").orderBy(F.col("keys").desc(), "u")
    starred = verified(enough_keys(met, num, den, single_from, share=2)
                       .withColumn("best", F.row_number().over(best)).filter("best = 1"), sets, num, den)
    # each node has one leader at most, so the leader's leader stands for most of a component
    above = starred.select(F.col("u").alias("above"), F.col("v").alias("u"))
    labels = cut_lineage(starred.join(above, "u", "left")
                         .select(F.col("v").alias("node"), F.coalesce("above", "u").alias("component")))

    free_shuffles(members.sparkSession)
    mixed = _mixed(members, labels)
    free_shuffles(members.sparkSession)
    a, b = mixed.alias("a"), mixed.alias("b")
    # the first two elements that similar sets share, or the key of both, leave room for the rest of the overlap
    fits = (f"{den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n) and "
            f"least(a.n - a.place, b.n - b.place) + 1 >= ceil({num} * (a.n + b.n) / {num + den}) and {near('a.n', 'b.n', 'a.odd', 'b.odd')}")
    pairs = (a.join(b, F.expr(f"a.key = b.key and a.component < b.component and {fits}"))
             .groupBy(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.n").alias("nu"), F.col("b.n").alias("nv"))
             .agg(F.count("*").alias("keys")))
    others = verified(enough_keys(pairs, num, den, single_from, most=2), sets, num, den)
    out = cut_lineage(connected_components(starred.unionByName(others)))
    discard(mixed, labels, starred, others)
    return out


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of keys whose members are in several components."""
    labelled = _labelled(members, labels)
    several = (labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
               .filter("x != y").select("key"))
    return cut_lineage(labelled.join(several, "key"))
