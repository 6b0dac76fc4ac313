"""Intervals and addresses: lookups by bucketed range joins, boundary texts, symbol extraction, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def widened(intervals: DataFrame) -> DataFrame:
    """Half-open [start, end); empty ones hold their start."""
    return intervals.withColumn("end", F.when(F.col("end") <= F.col("start"), F.col("start") + 1).otherwise(F.col("end")))


def lookup(points: DataFrame, intervals: DataFrame, key: list[str], width: int, how: str = "inner") -> DataFrame:
    """Points (key, at) with the intervals (key, start, end, ...) of the same key that hold them.

    Intervals are copied to each bucket of width they touch, so the join is by key and bucket, whatever their number;
    width should be about the usual length of an interval.
    """
    i = widened(intervals)
    i = i.select(*key, *[F.col(c).alias(f"_of_{c}") for c in i.columns if c not in key])
    touched = F.sequence(F.floor(F.col("_of_start") / width), F.floor((F.col("_of_end") - 1) / width))
    i = i.withColumn("_bucket", F.explode(touched))
    p = points.withColumn("_bucket", F.floor(F.col("at") / width))
    same = [F.col(f"_p.{c}") == F.col(f"_i.{c}") for c in (*key, "_bucket")]
    hit = p.alias("_p").join(i.alias("_i"), [*same, F.col("at") >= F.col("_of_start"), F.col("at") < F.col("_of_end")], how)
    return hit.select(*[F.col(f"_p.{c}") for c in points.columns], *[F.col(f"_of_{c}").alias(c) for c in intervals.columns if c not in key])


def outside(points: DataFrame, intervals: DataFrame, key: list[str], width: int) -> DataFrame:
    """Points that no interval holds, such as constants that are no address."""
    return lookup(points, intervals.select(*key, "start", "end"), key, width, "left").where("start is null").select(*points.columns)


def enveloped(outer: DataFrame, inner: DataFrame, key: list[str], width: int) -> DataFrame:
    """Each outer interval (key, start, end) with n, the inner ones that lie within it wholly."""
    o = widened(outer).select(*key, "start", "end").distinct()
    at = inner.select(*key, F.col("start").alias("at"), F.col("end").alias("inner_end"))
    hit = lookup(at, o, key, width).where(F.greatest("inner_end", F.col("at") + 1) <= F.col("end")).groupBy(*key, "start", "end").agg(F.count("*").alias("n"))
    return o.join(hit, [*key, "start", "end"], "left").select(*key, "start", "end", F.coalesce("n", F.lit(0)).alias("n"))


def accepted_boundaries(boundaries: DataFrame, symbols: DataFrame, key: list[str], width: int, most: int = 1 << 14, delayed: int = 1 << 11) -> DataFrame:
    """Boundaries to add as symbols, with late: they hold at most one symbol and most bytes; those over delayed come last."""
    n = enveloped(boundaries, symbols, key, width)
    size = F.col("end") - F.col("start")
    fine = n.where((F.col("n") <= 1) & (size <= most)).withColumn("late", size > delayed)
    # what a boundary taken in the first pass already begins is not added again in the second
    early = fine.where("not late").select(*key, F.col("start").alias("at"))
    taken = lookup(early, fine.where("late").select(*key, "start", "end"), key, width).select(*key, "start", "end").distinct()
    return fine.join(taken.withColumn("_t", F.lit(True)), [*key, "start", "end"], "left").where("not late or _t is null").drop("_t")


def extracted_symbols(symbols: DataFrame, largest: int = 1 << 16, fill: int = 32) -> tuple[DataFrame, DataFrame]:
    """Function symbols, and those that are too large.

    symbols: name, real_name, type, binding, size, vaddr, data. Kept: typed FUNC, LOOS or HIOS, not imported, bound, each
    (real_name, size, vaddr) once, and no constant filling of over fill bytes.
    """
    f = symbols.where(F.col("type").isin("FUNC", "LOOS", "HIOS") & ~F.startswith("name", F.lit("imp.")) & F.col("binding").isNotNull())
    big = f.where(F.col("size") > largest)
    hexed = F.hex("data")
    constant = (F.octet_length("data") > fill) & (hexed.rlike("^(00)+$") | hexed.rlike("^(FF)+$"))
    return f.where((F.col("size") <= largest) & ~F.coalesce(constant, F.lit(False))).dropDuplicates(["real_name", "size", "vaddr"]), big


# --- texts of other tools ---------------------------------------------------------------------------------------------


def _hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("decimal(20,0)")


def objdump_symbols(lines: DataFrame) -> DataFrame:
    """vaddr, size, name of address flags type section size name lines; functions only."""
    p = r"^([0-9a-fA-F]+)\s+.*?\bF\s+(\S+)\s+([0-9a-fA-F]+)\s+(?:\.hidden\s+)?(\S.*)$"
    return lines.where(F.col("value").rlike(p)).select(_hex(F.regexp_extract("value", p, 1)).alias("vaddr"), _hex(F.regexp_extract("value", p, 3)).alias("size"), F.regexp_extract("value", p, 4).alias("name"))


def nucleus_functions(lines: DataFrame) -> DataFrame:
    p = r"^function\s+(\d+):\s+entry@0x([0-9a-fA-F]+)\s+(\d+) bytes"
    return lines.where(F.col("value").rlike(p)).select(_hex(F.regexp_extract("value", p, 2)).alias("vaddr"), F.regexp_extract("value", p, 3).cast("decimal(20,0)").alias("size"), F.concat(F.lit("func."), F.regexp_extract("value", p, 1)).alias("name"))


def bap_functions(lines: DataFrame) -> DataFrame:
    p = r"^\((\S+) ([0-9a-fA-F]+) ([0-9a-fA-F]+)\)"
    start, end = _hex(F.regexp_extract("value", p, 2)), _hex(F.regexp_extract("value", p, 3))
    return lines.where(F.col("value").rlike(p)).select(start.alias("vaddr"), (end - start).cast("decimal(20,0)").alias("size"), F.regexp_extract("value", p, 1).alias("name"))


def ghidra_functions(lines: DataFrame) -> DataFrame:
    p = r"^0x([0-9a-fA-F]+)\s+(\d+)"
    return lines.where(F.col("value").rlike(p)).select(_hex(F.regexp_extract("value", p, 1)).alias("vaddr"), F.regexp_extract("value", p, 2).cast("decimal(20,0)").alias("size"), F.concat(F.lit("fcn."), F.regexp_extract("value", p, 1)).alias("name"))


def radare_functions(lines: DataFrame) -> DataFrame:
    """vaddr, size, name of address, blocks, size (or old -> new size) and name lines."""
    p = r"^0x([0-9a-fA-F]+)\s+\d+\s+(?:\d+\s+->\s+)?(\d+)\s+(\S+)"
    return lines.where(F.col("value").rlike(p)).select(_hex(F.regexp_extract("value", p, 1)).alias("vaddr"), F.regexp_extract("value", p, 2).cast("decimal(20,0)").alias("size"), F.regexp_extract("value", p, 3).alias("name"))


# --- blocks -------------------------------------------------------------------------------------------------------------


def blocks(leaders: DataFrame, ends: DataFrame) -> DataFrame:
    """function_id, start, end: from each leader to the next, the last to the function's end. ends: function_id, end."""
    own = leaders.select("function_id", F.col("address").alias("start")).distinct()
    nxt = F.lead("start").over(W.partitionBy("function_id").orderBy("start"))
    return own.withColumn("next", nxt).join(ends.withColumnRenamed("end", "stop"), "function_id").select("function_id", "start", F.coalesce("next", "stop").alias("end")).where("start < end")


def resolved_references(references: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """binary_id, function_id, kind, names: addresses looked up among named intervals (binary_id, kind, start, end, name)."""
    hit = lookup(references.withColumnRenamed("address", "at"), intervals, ["binary_id"], width)
    return hit.groupBy("binary_id", "function_id", "kind").agg(F.sort_array(F.collect_set("name")).alias("names"))


def resolved_imports(imports: DataFrame, relocations: DataFrame, strip: Column) -> DataFrame:
    """binary_id, name, vaddr: an import without address takes that of the relocation of its stripped name."""
    r = relocations.groupBy("binary_id", F.col("name").alias("stripped")).agg(F.min("vaddr").alias("reloc"))
    return imports.withColumn("stripped", strip).join(r, ["binary_id", "stripped"], "left").select("binary_id", "name", F.when(F.col("vaddr") == 0, F.coalesce("reloc", "vaddr")).otherwise(F.col("vaddr")).alias("vaddr"))


def inferred_parameters(binaries: DataFrame) -> DataFrame:
    """Fills linkage from the static flag, compiler (where unknown) and optimisation from segments of the path."""
    low = F.lower("path")
    compiler = F.regexp_extract(low, "/(gcc|clang|msvc|icc)/", 1)
    level = F.regexp_extract(low, "/(o[0-3sgz]|ofast)/", 1)
    return binaries.withColumns(
        {
            "linkage": F.when(F.col("static"), "static").otherwise("dynamic"),
            "compiler": F.when(F.col("compiler").isNull() | (F.col("compiler") == "unknown"), F.coalesce(F.nullif(compiler, F.lit("")), "compiler")).otherwise(F.col("compiler")),
            "optimisation": F.nullif(level, F.lit("")),
        }
    )


def binary_type(header: Column, executable_base: Column) -> Column:
    """From the ELF header's type: relocatable, executable, or shared, which with an entry interpreter is executable."""
    return F.when(header == 1, "object").when(header == 2, "executable").when((header == 3) & executable_base, "executable").when(header == 3, "shared_library")


def entry_names(entries: DataFrame, symbols: DataFrame) -> DataFrame:
    """binary_id, vaddr, name of main, csu_init and csu_fini: what the entry code puts in rdi, rcx and r8."""
    wanted = F.create_map(*[F.lit(x) for x in ("rdi", "main", "rcx", "csu_init", "r8", "csu_fini")])
    return entries.select("binary_id", F.col("value").alias("vaddr"), F.element_at(wanted, F.col("register")).alias("name")).where("name is not null").join(symbols.select("binary_id", "vaddr").distinct(), ["binary_id", "vaddr"], "left_semi")


def constructor_symbols(headers: DataFrame, strip) -> DataFrame:
    """binary_id, name, real_name, vaddr, size of the constructors and destructors that ELF headers list.

    headers: binary_id, constructors and destructors array<struct<name, address, size>>; strip(Column) -> bare name. Both
    are loaded when a program runs, so no call leads to them.
    """
    empty = lambda c: F.coalesce(c, F.slice(F.array(F.struct(F.lit("").alias("name"), F.lit(0).cast("long").alias("address"), F.lit(0).cast("long").alias("size"))), 1, 0))
    f = headers.select("binary_id", F.explode(F.concat(empty("constructors"), empty("destructors"))).alias("f"))
    return f.select("binary_id", strip(F.col("f.name")).alias("name"), F.col("f.name").alias("real_name"), F.col("f.address").alias("vaddr"), "f.size").distinct()


def init_names(entries: DataFrame, exits: DataFrame) -> DataFrame:
    """binary_id, vaddr, name init: what the first block of csu_init calls.

    entries: as of entry_names(); exits: binary_id, function (its address), bb_idx, target, jumpkind.
    """
    own = entries.where("name = 'csu_init' and vaddr <> 0").select("binary_id", F.col("vaddr").alias("function"))
    calls = exits.where("bb_idx = 0 and jumpkind = 'Ijk_Call' and target is not null").join(own, ["binary_id", "function"])
    return calls.groupBy("binary_id", "function").agg(F.min("target").alias("vaddr")).select("binary_id", "vaddr", F.lit("init").alias("name"))


def memory_bands(cells: DataFrame) -> DataFrame:
    """function_id, stack_vars, stack_args, heap_vars of m_0x.. cells against the stack [end, start], modulo 2^63."""
    at = F.conv(F.regexp_extract("cell", "^m_0x([0-9a-fA-F]+)$", 1), 16, 10).cast("decimal(20,0)") % F.lit(str(1 << 63)).cast("decimal(20,0)")
    band = F.when((at < F.col("stack_start")) & (at > F.col("stack_end")), "stack_vars").when((at >= F.col("stack_start")) & (at < F.col("stack_start") + 4096), "stack_args").otherwise("heap_vars")
    c = cells.where(F.startswith("cell", F.lit("m_0x"))).withColumn("band", band).select("function_id", "band", "cell").distinct()
    return c.groupBy("function_id").agg(*[F.count_if(F.col("band") == b).alias(b) for b in ("stack_vars", "stack_args", "heap_vars")])
