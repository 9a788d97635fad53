"""Who uses a name, told by counts: a member never meets the uses of its word one by one.

Uses are first reduced to distinct (word, unit, owner, heading), with Spark's partial aggregation before the shuffle, so a word that
stands everywhere costs a row a unit and owner. What is used from outside then is the count of a word's uses less those
in the member's own unit and in its descendants; these are looked up by two keys each. No join is on the word alone but that
with the counts, which has one row a word on its side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.tables import written


def references(members: DataFrame, uses: DataFrame, descendants: DataFrame, keep=written) -> DataFrame:
    """members with `external`, `subclass`, `unit` and `self` (1 or 0): where their word is used.

    members: `word`, `unit`, `owner` and others; uses: (word, unit, owner, heading), owner '' for none, heading for the headings of
    routines, which aren't uses of their owner's own member; descendants: (owner, descendant).
    external: in another unit, not by a descendant; subclass: by a descendant anywhere; unit: in the own unit by another
    owner; self: in the own unit by the owner.
    """
    uses = keep(uses.groupBy("word", "unit", "owner").agg(F.max(F.col("heading").cast("int")).alias("headed"), F.max((~F.col("heading")).cast("int")).alias("plain")), "uses")
    # a row counts once as a heading and once as a plain use
    number = F.col("headed") + F.col("plain")
    totals = uses.groupBy("word").agg(F.sum(number).alias("_all"))
    own = members.select("word", "unit", "owner").distinct()
    here = own.join(uses.withColumnRenamed("owner", "_by"), ["word", "unit"]).groupBy("word", "unit", "owner").agg(
        F.sum(number).alias("_here"), F.max(F.when(F.col("_by") != F.col("owner"), 1).otherwise(0)).alias("_unit"), F.max(F.when(F.col("_by") == F.col("owner"), F.col("plain")).otherwise(0)).alias("_self")
    )
    # headings of the own member in other units
    again = own.join(uses.withColumnRenamed("unit", "_in"), ["word", "owner"]).where("_in <> unit").groupBy("word", "unit", "owner").agg(F.sum("headed").alias("_again"))
    below = own.join(descendants.where("owner <> descendant").distinct(), "owner").join(uses.select("word", F.col("unit").alias("_in"), F.col("owner").alias("descendant"), "headed", "plain"), ["word", "descendant"])
    below = below.groupBy("word", "unit", "owner").agg(F.sum(F.when(F.col("_in") != F.col("unit"), number).otherwise(0)).alias("_below"), F.lit(1).alias("_sub"))
    by = ["word", "unit", "owner"]
    out = members.join(totals, "word", "left").join(here, by, "left").join(again, by, "left").join(below, by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    outside = zero("_all") - zero("_here") - zero("_again") - zero("_below")
    flags = {"external": F.when(outside > 0, 1).otherwise(0), "subclass": zero("_sub"), "unit": zero("_unit"), "self": zero("_self")}
    return out.select(*[c for c in members.columns if c != "unit"], F.col("unit").alias("home"), *[v.cast("int").alias(k) for k, v in flags.items()])
