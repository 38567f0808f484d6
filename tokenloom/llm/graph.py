"""Connected components of a link table, without collecting nodes or links anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.session import materialize


def scramble(x: Column) -> Column:
    """A reversible shuffle of the longs: minima then lie at random places of a chain."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (longs); equal roots are connected.

    Each round maps every node to its smallest neighbour and contracts the links; a chain
    shrinks by a constant share a round, a star in one. Every table of a round is written to
    the shared folder, so a lost executor costs no more than that round, and hot nodes meet
    plain scans in joins that adaptive execution can split.
    """
    a, b = scramble(F.col("a")), scramble(F.col("b"))
    links = materialize(
        links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "links"
    )
    labels = materialize(
        links.select(F.explode(F.array("a", "b")).alias("_at")).distinct().select("_at", F.col("_at").alias("_root")),
        "labels",
    )
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select("b", "a"))
        parents = materialize(
            both.groupBy("a").agg(F.min("b").alias("_up")).filter("_up < a").select(F.col("a").alias("_n"), "_up"),
            "parents",
        )
        labels = materialize(
            labels.join(parents, labels["_root"] == parents["_n"], "left")
            .select("_at", F.coalesce("_up", "_root").alias("_root")), "labels"
        )
        for end in ("a", "b"):
            links = links.join(parents, links[end] == parents["_n"], "left").select(
                F.coalesce("_up", end).alias(end), "b" if end == "a" else "a"
            )
        links = materialize(
            links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(),
            "links",
        )
    return labels.select(unscramble(F.col("_at")).alias("node"), "_root").withColumnRenamed("_root", "root")


def unscramble(x: Column) -> Column:
    """Inverse of :func:`scramble`."""
    for shift, step in ((F.shiftleft, 17), (F.shiftrightunsigned, 7), (F.shiftleft, 13)):
        y, k = x, step
        while k < 64:
            # doubles the number of settled bits: x ^ x<<s ^ x<<2s ...
            y, k = y.bitwiseXOR(shift(y, k)), 2 * k
        x = y
    return x
