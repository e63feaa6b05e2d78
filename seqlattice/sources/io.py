"""Sources and sinks: JSON and JSON Lines samples, similarity maps, budget and interval tables, result parts, run logs."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlattice.sources.split_json import split_items

STRUCT_IMAGES = "array<struct<id:string,path:string>>"
MESSAGE_SAMPLE = f"id string, messages array<struct<role:string,content:string>>, input_images {STRUCT_IMAGES}, output_images {STRUCT_IMAGES}"
BUDGET_TABLE = "img_paths array<string>, num_tokens array<int>"
#: Rows of a written JSON array, at most.
ARRAY_ROWS = 10_000
INTERVALS = "config struct<alpha:double>, tsim_intervals array<struct<tsim_left:double,tsim_right:double,budget:double>>"


def read_jsonl(spark: SparkSession, path, schema: str | T.StructType, check: bool = False) -> DataFrame:
    """JSON Lines; blank lines are skipped, a bad line fails the read. With ``check`` the files are read once before, and the error names
    the first bad line's file and number."""
    if check and (bad := bad_lines(spark, path, schema).orderBy("path", "line").head()) is not None:
        raise ValueError(f"{bad['path']}, line {bad['line']}: no such JSON: {bad['value'][:200]}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path, schema: str | T.StructType) -> DataFrame:
    """(path, line, value) of the lines that aren't JSON of the schema; blank lines count, and aren't bad.

    Large files are read in ranges. A line's number comes from the lines of the ranges before its own, a running sum over one small row a range.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    ranges = lines.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start")) - F.col("n")
    ranges = ranges.select("path", "start", "first", before.alias("before"))
    read = F.from_json("value", T.StructType([*kind.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    bad = lines.where(F.trim(F.translate("value", "\t\r", "  ")) != "").withColumn("_r", read).where(F.col("_r._bad").isNotNull() | F.col("_r").isNull())
    return bad.join(ranges, ["path", "start"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


#: Files up to which their row counts go to every task.
MOST_FILES = 100_000


def read_positions(spark: SparkSession, path, out: str = "position") -> DataFrame:
    """The rows of Parquet files with their place, 0, 1, 2 .., in the files' order by name and the rows' order in them.

    A row's place is its number in its file, which the reader knows, and the rows of the files before; the rows themselves are neither sorted nor shuffled.
    """
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = df.groupBy("_file").agg(F.count("*").alias("_n"))
    # one row a file
    base = counts.select(F.col("_file").alias("_of"), (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    base = F.broadcast(base) if len(counts.limit(MOST_FILES + 1).collect()) <= MOST_FILES else base
    return df.join(base, F.col("_file") == F.col("_of")).withColumn(out, F.col("_before") + F.col("_row")).drop("_file", "_row", "_of", "_before")


def read_json_array(spark: SparkSession, path, schema: str | T.StructType, partitions: int | None = None, mark: str | None = None) -> DataFrame:
    """Files that hold one JSON array each. A file is one task; large ones need ``mark``: the bracket that items have often, ``}`` (objects) or ``]``
    (lists), at which a file is then split (see ``split_json``), so that many tasks read it. ``partitions`` deals out the rows afterwards."""
    if mark:
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        df = split_items(spark, path, mark).select(_parsed("text", kind).alias("r")).select("r.*")
    else:
        df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.repartition(partitions) if partitions else df


def _parsed(text: str, kind: T.DataType) -> Column:
    """The JSON of a column; what can't be parsed is an error."""
    blank = F.trim(F.translate(text, "\t\r\n", "   ")) == ""
    return F.from_json(F.when(blank, F.raise_error(F.lit("an item is missing")).cast("string")).otherwise(F.col(text)), kind, {"mode": "FAILFAST"})


def detect_format(spark: SparkSession, path: str) -> str:
    """``array`` if the first character that isn't blank is ``[``, else ``jsonl``; an empty file is an error."""
    head = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).head()
    if head is None:
        raise ValueError(f"{path} is empty")
    return "array" if head[0] == "[" else "jsonl"


def read_samples(spark: SparkSession, path: str, schema: str | T.StructType = MESSAGE_SAMPLE, format: str | None = None) -> DataFrame:
    kind = format or detect_format(spark, path)
    return read_json_array(spark, path, schema) if kind == "array" else read_jsonl(spark, path, schema)


def read_similarity_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object {text of a path list: triangle} -> (img_paths, triangle); keys that aren't lists are dropped. A file is split at
    its items' borders (see ``split_json``), so that many tasks read a large one."""
    items = split_items(spark, path, "]", "{").select(F.concat(F.lit("{"), "text", F.lit("}")).alias("text"))
    pairs = items.select(F.explode(_parsed("text", T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.DoubleType()))))).alias("key", "triangle"))
    paths = F.from_json("key", "array<string>", {"allowSingleQuotes": "true"})
    return pairs.select(paths.alias("img_paths"), "triangle").where("img_paths is not null")


def read_budget_table(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, BUDGET_TABLE)


def read_intervals(spark: SparkSession, paths: list[str], budget_key: str = "budget", folder: str | None = None) -> DataFrame:
    """(scheme, alpha, tsim_left, tsim_right, budget) of interval files; the scheme is the file's name without ending, or what
    the files' folders ``<folder>=<scheme>`` say."""
    schema = INTERVALS.replace("budget:double", f"{budget_key}:double") + (f", `{folder}` string" if folder else "")
    df = spark.read.schema(schema).option("multiLine", True).json(paths)
    name = F.col(f"`{folder}`") if folder else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    flat = df.select(name.alias("scheme"), F.col("config.alpha").alias("alpha"), F.explode("tsim_intervals").alias("i"))
    return flat.select("scheme", "alpha", "i.tsim_left", "i.tsim_right", F.col(f"i.{budget_key}").alias("budget"))


def read_task_config(spark: SparkSession, path: str) -> DataFrame:
    """{group: [{path, token}]} -> (group_name, dataset_idx, path, token)."""
    whole = spark.read.text(path, wholetext=True)
    groups = whole.select(F.explode(F.from_json("value", "map<string,array<struct<path:string,token:string>>>")).alias("group_name", "tasks"))
    return groups.select("group_name", F.posexplode("tasks").alias("dataset_idx", "t")).select("group_name", "dataset_idx", "t.path", "t.token")


def read_parts(spark: SparkSession, path: str, schema: T.StructType | str, world_size: int | None = None, strict: bool = False, array: bool = True) -> DataFrame:
    """Result parts under ``path`` with their ``rank``: files ``result_part_rank<r>..``, or the files of folders
    ``result_part_rank=<r>`` as ``write_parts`` makes them (JSON Lines: ``array=False``). No part: an error.

    A file that should be an array and isn't is an error. With ``world_size``, missing ranks are an error if ``strict``, else a
    warning (``missing_parts`` lists them).
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    files = [r[0] for r in listed.where(F.col("path").rlike(r"/(result_part_rank[^/]*|result_part_rank=?\d+/[^/]*)$")).collect()]
    if not files:
        raise FileNotFoundError(f"no result parts under {path}")
    if array:
        # each file's first line that isn't blank, of its first range: its lines lie in one partition, in order
        lines = spark.read.text(files).where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
        heads = lines.select(F.col("_metadata.file_path").alias("path"), F.substring(F.ltrim("value"), 1, 1).alias("head"), F.monotonically_increasing_id().alias("at"))
        heads = heads.groupBy("path").agg(F.min_by("head", "at").alias("head"))
        if (bad := heads.where("head <> '['").head()) is not None:
            raise ValueError(f"{bad['path']} does not contain a list")
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("mode", "FAILFAST").option("multiLine", array)
    df = reader.json(files).withColumn("rank", F.regexp_extract(F.col("_metadata.file_path"), r"result_part_rank=?(\d+)(?:/[^/]*|[^/]*)$", 1).cast("int"))
    if world_size is not None:
        ranks = {int(re.search(r"result_part_rank=?(\d+)", f)[1]) for f in files}
        if gone := sorted(set(range(world_size)) - ranks):
            if strict:
                raise FileNotFoundError(f"missing result parts of ranks {gone}")
            warnings.warn(f"missing result parts of ranks {gone}", stacklevel=2)
    return df


def read_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, content): files as they are; decoding is the feature extractor's work."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


def write_image_lists(df: DataFrame, path: str, paths: str = "paths", index: str = "row_idx") -> None:
    """(row_idx, paths) as JSON Lines, in index order."""
    df.select(index, paths).orderBy(index).write.json(path)


def with_tokens_name(source: str) -> str:
    """The name that a data set gets with its tokens: ``<base>_with_tokens`` and the ending of its file, JSON or JSON Lines."""
    base = source.rstrip("/").rpartition("/")[2]
    for ending in (".jsonl", ".json"):
        if base.endswith(ending):
            return base.removesuffix(ending) + "_with_tokens" + ending
    raise ValueError(f"neither JSON nor JSON Lines: {source}")


def write_json_array(df: DataFrame, path: str, rows: int = ARRAY_ROWS) -> None:
    """A folder of files that hold one JSON array each, of at most ``rows`` rows."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        whole = lambda some: pd.DataFrame({"value": ["[\n" + ",\n".join(some) + "\n]"]})
        for b in batches:
            held += b["value"].tolist()
            while len(held) >= rows:
                yield whole(held[:rows])
                held = held[rows:]
        if held:
            yield whole(held)

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInPandas(pack, "value string").write.option("maxRecordsPerFile", 1).text(path)


def write_with_tokens(df: DataFrame, path: str, by: tuple[str, ...] = ("group_name", "dataset_idx"), source: str | None = None) -> str:
    """Data sets with their tokens, a folder for each of ``by``. With ``source``, the file that one data set came from: a folder
    under ``path`` of the name ``with_tokens_name`` gives it, of JSON Lines or of JSON arrays as it was. Returns the folder."""
    if source is None:
        df.write.partitionBy(*by).json(path)
        return path
    out = f"{path.rstrip('/')}/{with_tokens_name(source)}"
    write_json_array(df, out) if out.endswith(".json") else df.write.json(out)
    return out


def write_parts(df: DataFrame, path: str, ranks: int) -> None:
    """One folder ``result_part_rank=<r>`` a rank, by ``_global_idx`` modulo ``ranks``."""
    df.withColumn("result_part_rank", F.pmod("_global_idx", F.lit(ranks))).repartition(ranks, "result_part_rank").write.partitionBy("result_part_rank").json(path)


def append_records(df: DataFrame, path: str) -> None:
    """Adds run-log records, one folder a benchmark."""
    df.write.mode("append").partitionBy("benchmark").json(path)
