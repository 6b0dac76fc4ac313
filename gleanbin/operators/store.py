"""Relational queries over the corpus store: binaries, functions, prototypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def of_kind(binaries: DataFrame, kind: str) -> DataFrame:
    """The binaries of a type: executable, shared_library or object."""
    return binaries.where(F.col("bin_type") == kind)


def functions_of_kind(functions: DataFrame, binaries: DataFrame, kind: str) -> DataFrame:
    return functions.join(of_kind(binaries, kind).select(F.col("id").alias("binary_id")), "binary_id", "left_semi")


def binary_symbols(functions: DataFrame, binaries: DataFrame, path: str | Column) -> DataFrame:
    """The functions of the binary at path; an outer join whose filter makes it an inner one."""
    chosen = binaries.where(F.col("path") == path).select(F.col("id").alias("binary_id"), "path")
    return functions.join(chosen, "binary_id")


def global_symbols(functions: DataFrame, binaries: DataFrame, path: str, inference: bool = False) -> DataFrame:
    """As binary_symbols(), global ones only unless in inference."""
    own = binary_symbols(functions, binaries, path)
    return own if inference else own.where("binding = 'GLOBAL'")


def paths(binaries: DataFrame) -> DataFrame:
    return binaries.select("path").distinct()


def ids(binaries: DataFrame) -> DataFrame:
    return binaries.select("id")


def binary(binaries: DataFrame, id: int | None = None, sha256: bytes | None = None) -> DataFrame:
    """The binary of an id, or of a digest: one row or none."""
    chosen = F.col("id") == id if id is not None else F.col("sha256") == F.lit(sha256)
    return binaries.where(chosen).limit(1)


def id_of(binaries: DataFrame, path: str) -> DataFrame:
    """The id at path: one row or none."""
    return binaries.where(F.col("path") == path).select("id").limit(1)


def among(df: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    """Rows whose key is in the one column of chosen."""
    return df.join(chosen.toDF(key).distinct(), key, "left_semi")


def elements(functions: DataFrame, *columns: str) -> DataFrame:
    """name: the distinct elements of array columns."""
    every = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns])
    return functions.select(F.explode(every).alias("name")).distinct()


def constants(functions: DataFrame, numbers: Column) -> DataFrame:
    """constant: the distinct elements of an array of numbers."""
    return functions.select(F.explode(numbers).alias("constant")).distinct()


def callers_callees(functions: DataFrame, binaries: DataFrame, path: str, name: str) -> DataFrame:
    """The functions of a name in the binary at path, with their callers and callees."""
    return binary_symbols(functions, binaries, path).where(F.col("name") == name)


def feature_vectors(functions: DataFrame, vectors: DataFrame, limit: int | None = None) -> DataFrame:
    """id and vector of functions that have one; limit is the reader's own."""
    found = functions.select("id").join(vectors.where("vector is not null"), "id")
    return found if limit is None else found.orderBy("id").limit(limit)


def path_fields(df: DataFrame, path: str, fields: list[str]) -> DataFrame:
    """Adds the last segments of a path, one a field, empty ones as null."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return df.select("*", *[F.get(parts, F.size(parts) - len(fields) + k).alias(f) for k, f in enumerate(fields)])


def functions_at(calls: DataFrame, functions: DataFrame, width: int) -> DataFrame:
    """calls (id, binary_id, vaddr) with the function of their binary that holds the address."""
    from gleanbin.operators.intervals import lookup

    held = functions.withColumn("start", F.col("vaddr")).withColumn("end", F.col("vaddr") + F.col("size")).drop("vaddr", "size")
    return lookup(calls.withColumnRenamed("vaddr", "at"), held, ["binary_id"], width)


def symbols_named(functions: DataFrame, names: list[str]) -> DataFrame:
    """Functions of these names, in any binary."""
    return functions.where(F.col("name").isin(names))


def binaries_like(binaries: DataFrame, pattern: str) -> DataFrame:
    """Binaries whose path matches the regular expression."""
    return binaries.where(F.col("path").rlike(pattern))


def known_functions(functions: DataFrame) -> DataFrame:
    """name: all callees and callers."""
    return elements(functions, "callees", "callers")


def unknown_functions(functions: DataFrame) -> DataFrame:
    return functions.select("name").distinct()


def referenced_names(functions: DataFrame) -> DataFrame:
    """name: of functions, callers and callees."""
    return unknown_functions(functions).union(known_functions(functions)).distinct()


def frequent(items: DataFrame, column: str, above: int | None = None, below: int | None = None) -> DataFrame:
    """column, n: the values with above < n < below (both strict)."""
    n = items.groupBy(column).agg(F.count("*").alias("n"))
    if above is not None:
        n = n.where(F.col("n") > above)
    return n if below is None else n.where(F.col("n") < below)


def constants_band(functions: DataFrame, constants: Column, above: int, below: int, least_value: int | None = 1 << 16) -> DataFrame:
    """constant, n: the constants over least_value within the strict band of counts."""
    each = functions.select(F.explode(constants).alias("constant"))
    return frequent(each if least_value is None else each.where(F.col("constant") > least_value), "constant", above, below)


def resolve_library(libraries: DataFrame, pattern: str) -> DataFrame:
    """id of the libraries whose name matches the regular expression."""
    return libraries.where(F.col("name").rlike(pattern)).select("id")


def resolve_prototypes(names: DataFrame, prototypes: DataFrame, like: bool = False) -> DataFrame:
    """For each name the prototype of smallest id that has it; like takes names as LIKE patterns."""
    p = prototypes.withColumnRenamed("name", "proto_name")
    if like:
        wild = names.where(F.col("name").rlike("[%_]")).join(p, F.like("proto_name", F.col("name")))
        plain = names.where(~F.col("name").rlike("[%_]")).join(p, F.col("proto_name") == F.col("name"))
        found = wild.unionByName(plain)
    else:
        found = names.join(p, F.col("proto_name") == F.col("name"))
    return found.withColumn("_r", F.row_number().over(W.partitionBy("name").orderBy("id"))).where("_r = 1").drop("_r")


def linked_libraries(needed: DataFrame, libraries: DataFrame) -> DataFrame:
    """binary_id, complete, library_ids: the ids of all sonames that a binary needs, or none if one is missing."""
    clean = F.regexp_extract("soname", r"^(?:.*/)?((?:lib)?[A-Za-z0-9_+-]+?)(?:-[0-9.]+)?\.so", 1)
    found = needed.withColumn("lib", clean).join(libraries.select(F.regexp_extract("name", r"^(?:.*/)?((?:lib)?[A-Za-z0-9_+-]+?)(?:-[0-9.]+)?\.so", 1).alias("lib"), F.col("id").alias("library_id")).groupBy("lib").agg(F.min("library_id").alias("library_id")), "lib", "left")
    per = found.groupBy("binary_id").agg((F.count("library_id") == F.count("*")).alias("complete"), F.sort_array(F.collect_set("library_id")).alias("library_ids"))
    return per.withColumn("library_ids", F.when(F.col("complete"), F.col("library_ids")).otherwise(F.slice("library_ids", 1, 0)))


def with_embeddings(functions: DataFrame, binaries: DataFrame, embeddings: DataFrame, global_only: bool = True) -> DataFrame:
    """Functions with their path and embedding, those that have one."""
    f = functions.where("binding = 'GLOBAL'") if global_only else functions
    b = binaries.select(F.col("id").alias("binary_id"), "path")
    return f.join(b, "binary_id").join(embeddings.withColumnRenamed("function_id", "id"), "id").where("embedding is not null")


def without_embeddings(functions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The work queue: functions with no row or a null embedding."""
    return functions.join(embeddings.where("embedding is not null").select(F.col("function_id").alias("id")), "id", "left_anti")


def remap_splits(old: DataFrame, binaries: DataFrame, present: DataFrame) -> DataFrame:
    """split, id: an old split by path on today's ids, those present only."""
    return old.join(binaries.select("path", "id"), "path").select("split", "id").join(present.select("id").distinct(), "id", "left_semi")


# --- document-store pipelines -----------------------------------------------------------------------------------------


def distinct_sizes(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.size(column).alias("size")).distinct()


def selected(df: DataFrame, wanted: dict[str, list], allowed: list[str], columns: list[str], sample: int | None = None, seed: int = 0) -> DataFrame:
    """Rows whose allowed columns are among the wanted values; sample of them by a seeded hash of the whole row."""
    for key, values in wanted.items():
        if key in allowed:
            df = df.where(F.col(key).isin(values))
    out = df.select(*columns)
    return out if sample is None else out.orderBy(F.xxhash64(*columns, F.lit(seed))).limit(sample)


def grouped_by_name(df: DataFrame, value: str) -> DataFrame:
    """name, values, paths of each symbol name."""
    return df.groupBy("name").agg(F.sort_array(F.collect_list(value)).alias("values"), F.sort_array(F.collect_set("path")).alias("paths"))


def static_only(symbols: DataFrame) -> DataFrame:
    """Names that have no dynamic row."""
    return symbols.select("name").distinct().join(symbols.where("linkage = 'dynamic'").select("name").distinct(), "name", "left_anti")


def dynamic_imports(functions: DataFrame) -> DataFrame:
    """name: what is referenced but nowhere defined."""
    return known_functions(functions).join(unknown_functions(functions), "name", "left_anti")


def xref_counts(functions: DataFrame) -> DataFrame:
    """path, n: callees and callers together."""
    return functions.groupBy("path").agg(F.sum(F.size(F.coalesce("callees", F.array().cast("array<string>"))) + F.size(F.coalesce("callers", F.array().cast("array<string>")))).alias("n"))


def by_library_path(df: DataFrame, pattern: str, known: bool) -> DataFrame:
    """Rows of known binaries (path matches, in any case) or of the others."""
    match = F.col("path").rlike(f"(?i){pattern}")
    return df.where(match if known else ~match)


def callers_of(functions: DataFrame) -> DataFrame:
    """binary_id, name, callers: callee lists turned round within each binary."""
    calls = functions.select("binary_id", F.col("name").alias("caller"), F.explode("callees").alias("name"))
    return calls.groupBy("binary_id", "name").agg(F.sort_array(F.collect_set("caller")).alias("callers"))


def symbol_lookup(wanted: DataFrame, defined: DataFrame, imported: DataFrame, prototypes: DataFrame) -> DataFrame:
    """name, source, value: the definition, else the import, else the prototype."""
    one = lambda df, c: df.groupBy("name").agg(F.min("value").alias(c))
    d = wanted.join(one(defined, "d"), "name", "left").join(one(imported, "i"), "name", "left").join(one(prototypes, "p"), "name", "left")
    source = F.when(F.col("d").isNotNull(), "defined").when(F.col("i").isNotNull(), "imported").when(F.col("p").isNotNull(), "prototype")
    return d.select("name", source.alias("source"), F.coalesce("d", "i", "p").alias("value"))


def resolved_arguments(calls: DataFrame, prototypes: DataFrame, strip: Column) -> DataFrame:
    """name, arguments: by the name itself, the stripped name, the name without 32 or 64 at its end, else none."""
    p = lambda c: prototypes.groupBy(F.col("name").alias(c)).agg(F.min("arguments").alias(f"args_{c}"))
    d = calls.select("name").distinct().withColumn("stripped", strip).withColumn("bare", F.regexp_replace("stripped", "(32|64)$", ""))
    d = d.join(p("name"), "name", "left").join(p("stripped"), "stripped", "left").join(p("bare"), "bare", "left")
    return d.select("name", F.coalesce("args_name", "args_stripped", "args_bare", F.array().cast("array<string>")).alias("arguments"))
