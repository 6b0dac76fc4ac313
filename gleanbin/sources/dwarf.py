"""Prototypes from debug information: entries (binary_id, offset, parent, tag, name, type) as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanbin.plans.tables import written


def type_names(entries: DataFrame) -> DataFrame:
    """binary_id, offset, type_name: pointers add *, constants const, other entries without a name take that of their type.

    Each round follows one reference for the entries that are not named yet, until none is left to follow. A chain that
    comes back to itself, which no round can end, is void from where it does: it is left after as many rounds as it has
    entries at most, when every entry still on its way has been seen before.
    """
    own, _ = written(entries.select("binary_id", "offset", "tag", "name", "type"), "dwarf")
    to = own.select("binary_id", F.col("offset").alias("to"), F.col("tag").alias("t_tag"), F.col("name").alias("t_name"), F.col("type").alias("t_type"))
    empty = F.array().cast("array<long>")
    found = own.select("binary_id", F.col("offset").alias("at"), F.col("offset").cast("long").alias("on"), F.lit("").alias("before"), F.lit("").alias("after"), "tag", "name", "type", empty.alias("seen"))
    done = None
    while True:
        follow = F.col("type").isNotNull() & (F.col("tag").isin("pointer_type", "const_type") | F.col("name").isNull())
        round_again = F.array_contains("seen", F.col("on"))
        end = found.where(~follow | round_again).select("binary_id", F.col("at").alias("offset"), F.concat("before", F.coalesce(F.when(~round_again | ~follow, F.col("name")), F.lit("void")), "after").alias("type_name"))
        done = end if done is None else done.unionByName(end)
        going = found.where(follow & ~round_again).withColumn("to", F.col("type")).join(to, ["binary_id", "to"], "left")
        step = going.select(
            "binary_id",
            "at",
            F.col("to").cast("long").alias("on"),
            F.concat("before", F.when(F.col("tag") == "const_type", "const ").otherwise("")).alias("before"),
            F.concat(F.when(F.col("tag") == "pointer_type", "*").otherwise(""), "after").alias("after"),
            F.col("t_tag").alias("tag"),
            F.col("t_name").alias("name"),
            F.col("t_type").alias("type"),
            F.concat("seen", F.array("on")).alias("seen"),
        )
        found, _ = written(step, "dwarf-step")
        if not found.limit(1).count():
            return done


def prototypes(entries: DataFrame) -> DataFrame:
    """binary_id, name, returns, params of each named subprogram."""
    names = type_names(entries)
    of = lambda c: names.select("binary_id", F.col("offset").alias("type"), F.col("type_name").alias(c))
    functions = entries.where("tag = 'subprogram' and name is not null").join(of("returns"), ["binary_id", "type"], "left").select("binary_id", "offset", "name", F.coalesce("returns", F.lit("void")).alias("returns"))
    params = entries.where("tag = 'formal_parameter'").join(of("kind"), ["binary_id", "type"], "left").groupBy("binary_id", F.col("parent").alias("_p")).agg(F.sort_array(F.collect_list(F.struct("offset", F.struct(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("kind", F.lit("void")).alias("type")).alias("p")))).alias("l"))
    params = params.select("binary_id", F.col("_p").alias("offset"), F.transform("l", lambda x: x["p"]).alias("params"))
    return functions.join(params, ["binary_id", "offset"], "left").select("binary_id", "name", "returns", "params")
