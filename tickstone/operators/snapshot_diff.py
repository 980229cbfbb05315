"""What changed between consecutive full snapshots, by sums of signed cells.

Each snapshot is unpivoted into (key, field, value) cells and a presence marker per key. A cell counts +1 in the comparison
that ends at its snapshot and -1 in the next one. Cells alike in both snapshots cancel; what is left classifies the
key: a marker of +1 is added, of -1 removed, none with fields left is changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickstone.functions.columns import day_text, norm_hash, norm_path, norm_symbol, parse_day, strip
from tickstone.operators.deliveries import standing

def snapshot_diff(cells: DataFrame) -> DataFrame:
    """``scope, as_of, item, change, fields``: one row for each key that differs between consecutive snapshots.

    ``cells``: ``scope, block, seq, as_of, next_as_of, item, field, value``, one row for each field of a key, and one with a null
    ``field`` that marks its presence; laid out by (scope, block) as ``standing`` leaves them. ``as_of`` is the later snapshot; a
    scope's first one gives no rows. ``fields`` lists the changed fields, for ``changed`` only. A null value is a value like any other.
    Sums are made twice: first where the snapshots lie, consecutive ones side by side, which leaves what has changed and the cells at
    the edges of a block; then, after one exchange by (scope, date, item), over all. No scope is gathered.
    """
    signs = F.array(
        F.struct(F.when(F.col("seq") > 1, F.col("as_of")).alias("at"), F.lit(1).alias("sign")),
        F.struct(F.col("next_as_of").alias("at"), F.lit(-1).alias("sign")),
    )
    signed = cells.select("scope", "block", "item", "field", "value", F.explode(signs).alias("s"))
    signed = signed.select("scope", "block", F.col("s.at").alias("as_of"), "item", "field", "value", F.col("s.sign").alias("sign")).where("as_of is not null")
    cell = ["scope", "as_of", "item", "field", "value"]
    here = signed.groupBy("block", *cell).agg(F.sum("sign").alias("sign")).where("sign <> 0")
    left = here.repartition("scope", "as_of", "item").groupBy(*cell).agg(F.sum("sign").alias("n")).where("n <> 0")
    rows = left.groupBy("scope", "as_of", "item").agg(
        F.coalesce(F.sum(F.when(F.col("field").isNull(), F.col("n"))), F.lit(0)).alias("n"),
        F.array_sort(F.collect_set("field")).alias("fields"),
    )
    change = F.when(F.col("n") > 0, "added").when(F.col("n") < 0, "removed").otherwise("changed")
    none = F.array().cast("array<string>")
    return rows.select("scope", day_text("as_of").alias("as_of"), "item", change.alias("change"), F.when(F.col("n") == 0, F.col("fields")).otherwise(none).alias("fields"))


PLACE = ["scope", "block", "seq", "as_of", "next_as_of"]


def member_cells(snapshots: DataFrame) -> DataFrame:
    """Members of the standing deliveries of ``universe_snapshots``: presence only."""
    s = standing(snapshots, strip("index_name"), parse_day("as_of"), F.col("retrieved_at"), F.col("symbols"))
    member = F.explode(F.array_distinct(F.transform("items", norm_symbol))).alias("item")
    nothing = F.lit(None).cast("string")
    return s.select(*PLACE, member).where("item is not null").withColumns({"field": nothing, "value": nothing})


def file_cells(manifests: DataFrame) -> DataFrame:
    """Files of the standing deliveries of ``snapshot_manifests`` with the field ``sha256``.

    A path given in two spellings counts once, with the greatest of its hashes; blank paths are left out.
    """
    s = standing(manifests, strip("store_name"), parse_day("universe_as_of"), F.col("published_at"), F.col("curated_files_sha256"))
    entries = F.transform("items", lambda e: F.struct(norm_path(e["key"]).alias("key"), norm_hash(e["value"]).alias("value")))
    s = s.withColumn("items", F.array_sort(entries))
    once = F.filter("items", lambda e, i: F.coalesce(F.get(F.col("items"), i + 1)["key"] != e["key"], F.lit(True)) & (e["key"] != ""))
    nothing = F.lit(None).cast("string")

    def cells(e: Column) -> Column:
        there = F.struct(e["key"].alias("item"), nothing.alias("field"), nothing.alias("value"))
        return F.array(there, F.struct(e["key"].alias("item"), F.lit("sha256").alias("field"), e["value"].alias("value")))

    return s.select(*PLACE, F.inline(F.flatten(F.transform(once, cells))))


def delivery_changes(snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """``scope, as_of, item, change, fields`` of index members and of files together."""
    return snapshot_diff(member_cells(snapshots)).unionByName(snapshot_diff(file_cells(manifests)))
