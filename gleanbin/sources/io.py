"""Sources and sinks: binaries on disk, text formats, settings, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ELF_MAGIC = "7F454C46"
LARGEST = 128 << 20


# --- binaries -----------------------------------------------------------------------------------------------------


def is_elf(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)) == ELF_MAGIC


def collect_binaries(spark: SparkSession, folder: str, known: DataFrame | None = None, denied: DataFrame | None = None, with_content: bool = False) -> DataFrame:
    """path, size (and content) of the ELF files under folder: not empty, at most 128 MiB, neither known nor denied."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.where(F.col("length").between(1, LARGEST) & is_elf(F.col("content")))
    for other in (known, denied):
        if other is not None:
            files = files.join(other.select("path"), "path", "left_anti")
    return files.select("path", F.col("length").alias("size"), *(["content"] if with_content else []))


def library_files(files: DataFrame) -> DataFrame:
    """Shared libraries by path: .so with or without a version, neither objects nor archives."""
    return files.where(F.col("path").rlike(r"\.so(\.[0-9]+)*$") & ~F.col("path").rlike(r"\.(o|a)$"))


def largest_first(files: DataFrame, parts: int) -> DataFrame:
    """Files spread so that each partition works on its largest first."""
    return files.repartition(parts, "path").sortWithinPartitions(F.desc("size"), "path")


def with_id(df: DataFrame, key: str = "path") -> DataFrame:
    """A stable id from the key: the same in every run and partitioning."""
    return df.withColumn("id", F.xxhash64(key))


def new_rows(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """The incoming rows whose key is not stored."""
    return incoming.join(stored.select(*key).distinct(), key, "left_anti")


#: The machine number of x86_64 in an ELF header (little endian), and seconds for one binary at most.
X86_64, MOST_SECONDS = "3E00", 90 * 60


def is_x86_64(content: Column) -> Column:
    return is_elf(content) & (F.hex(F.substring(content, 19, 2)) == X86_64)


def within(seconds: float, call, *args):
    """call(*args), or TimeoutError once it has taken so long. In a worker's main thread; elsewhere without a limit."""
    import signal
    import threading

    if threading.current_thread() is not threading.main_thread():
        return call(*args)

    def stop(number, frame):
        raise TimeoutError(f"more than {seconds:g} seconds")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return call(*args)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def analysed(files: DataFrame, analyse, schema: str, seconds: float = MOST_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Rows of analyse(path, content) -> dicts, and path, error of the files on which it fails or takes too long."""
    import pandas as pd

    full = f"{schema}, error_path string, error string"

    def run(batches):
        names = [x.split(" ")[0] for x in schema.split(", ")]
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [{**r, "error_path": None, "error": None} for r in within(seconds, analyse, path, bytes(content))]
                except Exception as e:  # noqa: BLE001  one bad file is a row of its own, not a failed job
                    rows.append({n: None for n in names} | {"error_path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=[*names, "error_path", "error"])

    out = files.mapInPandas(run, full)
    return out.where("error is null").drop("error_path", "error"), out.where("error is not null").select(F.col("error_path").alias("path"), "error")


# --- upserts ------------------------------------------------------------------------------------------------------


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """Incoming rows replace stored rows of equal key; of several incoming rows that of the highest version."""
    names = stored.columns
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.select(*names).withColumn("_new", F.lit(1)))
    latest = W.partitionBy(*key).orderBy(F.desc("_new"), *([F.desc(version)] if version else []), *[F.desc(c) for c in names if c not in key and c != version])
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select(*names)


def add_analysed(binaries: DataFrame, functions: DataFrame, analysed_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store's binaries and functions with those of analysed binaries, each a row with its functions nested.

    analysed_: the columns of binaries without id, and functions array<struct> of the columns of functions without id and
    binary_id. Ids are hashes of the path, and of path and place, so they are the same in every run; a binary that is
    there already is replaced with all its functions.
    """
    new = with_id(analysed_)
    rows = new.select(F.col("id").alias("binary_id"), "path", F.posexplode("functions").alias("_place", "_f"))
    own = rows.select(F.xxhash64("path", "_place").alias("id"), "binary_id", "_f.*")
    kept = functions.join(new.select(F.col("id").alias("binary_id")), "binary_id", "left_anti")
    return upsert(binaries, new.drop("functions"), ["id"]), kept.select(*functions.columns).unionByName(own.select(*functions.columns))


def add_library(libraries: DataFrame, prototypes: DataFrame, path: str, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store's libraries and prototypes with those of one library's functions; prototypes there already stay."""
    name = path.rsplit("/", 1)[-1]
    library = with_id(functions.sparkSession.createDataFrame([(path, name)], "path string, name string")).select(*libraries.columns)
    of = functions.crossJoin(F.broadcast(library.select(F.col("id").alias("library"))))  # one row
    new = of.withColumn("id", F.xxhash64("library", "name")).select(*prototypes.columns)
    return upsert(libraries, library, ["id"]), prototypes.unionByName(new_rows(new, prototypes, ["library", "name"]))


def upsert_columns(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Sets the columns that incoming has, of stored or new keys; the others stay, or are null."""
    own = [c for c in incoming.columns if c not in key]
    new = incoming.select(*key, *[F.col(c).alias(f"_new_{c}") for c in own])
    both = stored.join(new, key, "full_outer")
    return both.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in own else F.col(c) for c in stored.columns])


# --- sparse text matrices -------------------------------------------------------------------------------------------


def matrix_lines(entries: DataFrame, rows: int, cols: int) -> DataFrame:
    """line_no, value: a header of rows and columns, then idx:%.6f of the non-zero entries (row, idx, value), one line a row."""
    cell = F.concat(F.col("idx").cast("string"), F.lit(":"), F.format_string("%.6f", F.col("value")))
    full = entries.where("value <> 0").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("idx", cell.alias("cell")))).alias("c"))
    body = entries.sparkSession.range(rows).withColumnRenamed("id", "row").join(full, "row", "left")
    lines = body.select((F.col("row") + 1).alias("line_no"), F.coalesce(F.array_join(F.transform("c", lambda x: x["cell"]), " "), F.lit("")).alias("value"))
    return entries.sparkSession.range(1).select(F.lit(0).cast("long").alias("line_no"), F.lit(f"{rows} {cols}").alias("value")).unionByName(lines)


def write_matrix(entries: DataFrame, rows: int, cols: int, path: str) -> None:
    matrix_lines(entries, rows, cols).repartitionByRange("line_no").sortWithinPartitions("line_no").select("value").write.mode("overwrite").text(path)


def parse_matrix(lines: DataFrame) -> DataFrame:
    """row, idx, value of line_no, value lines."""
    cells = lines.where("line_no > 0 and value <> ''").select((F.col("line_no") - 1).alias("row"), F.explode(F.split("value", " ")).alias("c"))
    return cells.select("row", F.split_part("c", F.lit(":"), F.lit(1)).cast("int").alias("idx"), F.split_part("c", F.lit(":"), F.lit(2)).cast("double").alias("value"))


def line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0), value of a text folder: files by name, lines in order, without one global sort.

    Ids rise along each split that is read; the lines of all splits before it are added. Only a row a split is ordered.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("i"))
    sizes = lines.groupBy("file", "start").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.join(sizes.withColumn("before", before).drop("n"), ["file", "start"]).select((F.col("before") + F.col("i") - F.col("first")).alias("line_no"), "value")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """row, idx, value of a written matrix."""
    return parse_matrix(line_numbers(spark, path))


def numbered_lines(items: DataFrame, value: str, pattern: str = "%s") -> DataFrame:
    """index:value lines, such as label names (%s) or inverse propensities (%.4f)."""
    return items.select(F.col("idx").alias("line_no"), F.concat(F.col("idx").cast("string"), F.lit(":"), F.format_string(pattern, F.col(value))).alias("value"))


def parse_numbered(lines: DataFrame) -> DataFrame:
    """idx, label of index:label lines."""
    return lines.select(F.split_part("value", F.lit(":"), F.lit(1)).cast("int").alias("idx"), F.regexp_replace("value", "^[^:]*:", "").alias("label"))


def non_blank_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


# --- names and vectors ----------------------------------------------------------------------------------------------


def name_dataset(lines: DataFrame) -> DataFrame:
    """function_name, labels of tab-separated number, name, a_b_c lines; lines of another shape are skipped."""
    parts = F.split("value", "\t")
    return lines.where(F.size(parts) == 3).select(parts[1].alias("function_name"), F.filter(F.split(F.trim(parts[2]), "_"), lambda x: x != "").alias("labels"))


def word_vectors(lines: DataFrame) -> DataFrame:
    """word, vector of a text of word vectors; a header of two numbers is skipped."""
    parts = F.split(F.trim("value"), " +")
    return lines.where(F.size(parts) > 2).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, 1 << 30), lambda x: x.cast("double")).alias("vector"))


def merge_xrefs(records: DataFrame, strip: Column) -> DataFrame:
    """Per path and name the sets of callees and callers of JSON cross-reference records (path, name, ct, cf)."""
    named = records.withColumn("name", strip)
    both = named.select("path", "name", F.explode_outer("ct").alias("ct"), F.lit(None).cast("string").alias("cf")).unionByName(named.select("path", "name", F.lit(None).cast("string").alias("ct"), F.explode_outer("cf").alias("cf")))
    return both.groupBy("path", "name").agg(F.sort_array(F.collect_set("ct")).alias("callees"), F.sort_array(F.collect_set("cf")).alias("callers"))


# --- settings -------------------------------------------------------------------------------------------------------


def save_settings(tables: dict[str, DataFrame], folder: str) -> None:
    """Vocabularies and splits, a Parquet table each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_settings(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def latest_results(results: DataFrame) -> DataFrame:
    """experiment, key, value: the newest of each key of an append-only table with ts."""
    return results.groupBy("experiment", "key").agg(F.max_by("value", "ts").alias("value"))


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 8, low: int = 0, high: int = 1) -> DataFrame:
    """A table of a running database; with key, read in parts of its range."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key:
        reader = reader.option("partitionColumn", key).option("numPartitions", parts).option("lowerBound", low).option("upperBound", high)
    return reader.load()
