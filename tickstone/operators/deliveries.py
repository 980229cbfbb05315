"""Repeated full deliveries of a table: which delivery stands for each date, and the order of the standing ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OLDEST = "0001-01-01 00:00:00"
#: days of a scope whose deliveries lie together
BLOCK_DAYS = 256


def standing(deliveries: DataFrame, scope: Column, as_of: Column, published: Column, items: Column) -> DataFrame:
    """Rows ``scope, block, as_of (date), seq (from 1), next_as_of, items``: the delivery that counts for each (scope, as_of).

    Of the deliveries whose ``items`` (array or map) are neither null nor empty, the one published last; a null
    ``published`` ranks first in time; of several published at one instant the greatest hash of ``items`` decides.
    Rows without scope or date are dropped, repeated rows count once. ``seq`` and ``next_as_of`` follow the standing
    deliveries of a scope by date; ``next_as_of`` is null at the last. A map's entries come as an array, by key.
    Work: the items are read and moved once, by scope and ``block`` (``BLOCK_DAYS`` of a scope), and the result is laid out so: later
    steps find consecutive deliveries side by side, and no scope is gathered into one task. The order is made from one
    narrow row a standing delivery, taken from the same exchange.
    """
    # a map has no hash: its sorted entries have
    is_map = deliveries.select(items.alias("x")).schema["x"].dataType.typeName() == "map"
    listed = F.array_sort(F.map_entries(items)) if is_map else items
    rows = deliveries.where((F.size(items) > 0) & scope.isNotNull() & as_of.isNotNull()).select(
        scope.alias("scope"),
        F.floor(F.unix_date(as_of) / BLOCK_DAYS).cast("int").alias("block"),
        as_of.alias("as_of"),
        F.coalesce(published, F.lit(OLDEST).cast("timestamp")).alias("__at"),
        listed.alias("items"),
    )
    # stated, as the join below asks for it: else the two branches would differ under the exchange, which would be made twice
    rows = rows.where("scope is not null and block is not null")
    latest = F.max(F.struct("__at", F.xxhash64("items").alias("__hash"), "items"))
    best = rows.repartition("scope", "block").groupBy("scope", "block", "as_of").agg(latest.alias("b"))
    best = best.select("scope", "block", "as_of", F.col("b.items").alias("items"))
    by_date = Window.partitionBy("scope").orderBy("as_of")
    # the size keeps the items in this branch up to the exchange, so that both branches share it
    narrow = best.select("scope", "block", "as_of", F.size("items").alias("n")).where("n > 0")
    order = narrow.select("scope", "block", "as_of", F.row_number().over(by_date).alias("seq"), F.lead("as_of").over(by_date).alias("next_as_of"))
    by_block = order.groupBy("scope", "block").agg(F.map_from_entries(F.collect_list(F.struct("as_of", F.struct("seq", "next_as_of")))).alias("__order"))
    own = F.col("__order")[F.col("as_of")]
    return best.join(by_block, ["scope", "block"]).select("scope", "block", "as_of", own["seq"].alias("seq"), own["next_as_of"].alias("next_as_of"), "items")
