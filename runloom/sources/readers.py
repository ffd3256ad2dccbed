"""File sources: state, configurations, evaluation rows, logs, queues, registries, telemetry."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions.names import file_stem, parent_name
from runloom.functions.resources import job_state
from runloom.plans.ordering import top_per_group
from runloom.session import shared_dir

FILE_PATH = "_metadata.file_path"
FILE_TIME = "_metadata.file_modification_time"


def written(df: DataFrame, label: str, spark: SparkSession) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _texts(spark: SparkSession, path: str, whole: bool, glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=whole)


def _plain(escaped: Column) -> Column:
    """A percent-escaped path or partition value as it was."""
    return F.url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B")))


def file_path() -> Column:
    return _plain(F.col(FILE_PATH))


#: Splits whose states are sent to all tasks; more are joined and their rows sorted again.
BROADCAST_SPLITS = 1_000_000


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The batches cut where a split begins, told by file and start; the flag is set where a new one does."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column("file")), np.asarray(batch.column("start"))], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for begin, end in zip(cuts, cuts[1:]):
            key = tuple(keys[begin])
            yield key != last, batch.slice(begin, end - begin)
            last = key


def _before(steps: np.ndarray) -> np.ndarray:
    """Running sums without the own step."""
    return np.cumsum(steps) - steps


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(batch.column(n)).astype(np.int64) for n in names]


def _depth_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every split the sums of quotes and of changes of depth, the latter if it begins outside of a string and inside."""
    names = ["file", "start", "n_odd", "n_from_out", "n_from_in"]
    own: list[list[int]] = []
    for new, part in _splits(batches):
        if new:
            own.append([part.column("file")[0].as_py(), part.column("start")[0].as_py(), 0, 0, 0])
        odd, if_out, if_in = _numbers(part, "odd", "if_out", "if_in")
        inside = (own[-1][2] + _before(odd)) % 2 == 1
        for k, step in ((2, odd), (3, np.where(inside, if_in, if_out)), (4, np.where(inside, if_out, if_in))):
            own[-1][k] += int(step.sum())
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*own)] or [pa.array([], pa.int64())] * 5, names)


RECORD = "file bigint, start bigint, line bigint, begins boolean, edge boolean, opens boolean, closes boolean, value string"


def _records_of(separator: str):
    """Pieces of a file in order, with the state their split begins in, as records; a split's first and last ones may go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, odd_before, depth = [], [], 0, 0  # the open record: file, start, line, begins, edge, opens; its pieces
        closes = False
        for new, part in _splits(batches):
            done = []
            if new:
                if held:
                    done.append((*place[:4], True, place[5], closes, separator.join(held)))
                place, held = [], []
                odd_before, depth = part.column("began_in")[0].as_py(), part.column("deep")[0].as_py()
            odd, if_out, if_in, line = _numbers(part, "odd", "if_out", "if_in", "line")
            value = part.column("value").to_pylist()
            inside = (odd_before + _before(odd)) % 2 == 1
            change = np.where(inside, if_in, if_out)
            deep = depth + _before(change)
            odd_before, depth = odd_before + int(odd.sum()), depth + int(change.sum())
            after = deep + change
            split = part.column("file")[0].as_py(), part.column("start")[0].as_py()
            begins = np.flatnonzero(~inside & (deep <= 1)).tolist()
            for at, end in zip([0, *begins], [*begins, len(value)]):
                if at == end:
                    continue
                if (begun := bool(begins) and at >= begins[0]) or not held:
                    if held:
                        done.append((*place[:5], place[5], closes, separator.join(held)))
                    # The first record of a split may be the rest of one begun before.
                    place, held = [*split, int(line[at]), begun, not begun, bool(deep[at] == 0)], []
                held += value[at:end]
                closes = bool(after[end - 1] == 0)
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(zip(*done), [pa.int64()] * 3 + [pa.bool_()] * 4 + [pa.string()])], RECORD_NAMES)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip(
                (*place[:4], True, place[5], closes, separator.join(held)), [pa.int64()] * 3 + [pa.bool_()] * 4 + [pa.string()])], RECORD_NAMES)

    return run


RECORD_NAMES = [field.split()[0] for field in RECORD.split(", ")]


def _put_together(pieces: DataFrame, states: DataFrame, separator: str, ordered: bool = True) -> DataFrame:
    """(file, opens, closes, value): the pieces of every record joined.

    ``pieces``: file, start, line, value, and by how much a piece changes the number of quotes (``odd``) and the depth in
    brackets, beginning outside of a string (``if_out``) or inside (``if_in``). ``states``: a row for each split with the state
    it begins in (``began_in``, ``deep``). A record begins outside of strings and at most one bracket deep.

    Rows of a scan come split by split and in order (``ordered``), so records are joined as they stream by, without a shuffle;
    only the records at the ends of splits, two a split, are brought together.
    """
    few = states.count() <= BROADCAST_SPLITS
    met = pieces.join(F.broadcast(states) if few else states, ["file", "start"]).select(
        "file", "start", "line", "value", "odd", "if_out", "if_in", "began_in", "deep")
    if not (few and ordered):
        met = met.repartition("file", "start").sortWithinPartitions("file", "start", "line")
    records = written(met.mapInArrow(_records_of(separator), RECORD), "records", pieces.sparkSession)
    place = F.struct("start", "line")
    upto = Window.partitionBy("file").orderBy("start", "line").rowsBetween(Window.unboundedPreceding, 0)
    ends = records.filter("edge").withColumn("record", F.last(F.when(F.col("begins"), place), ignorenulls=True).over(upto))
    whole = ends.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "line", "opens", "closes", "value"))).alias("p")).select(
        "file", F.col("p")[0]["opens"].alias("opens"), F.element_at("p", -1)["closes"].alias("closes"),
        F.array_join(F.transform("p", lambda p: p["value"]), separator).alias("value"))
    return records.filter("not edge").select("file", "opens", "closes", "value").unionByName(whole)


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _json_members(spark: SparkSession, path: str, glob: str | None) -> tuple[DataFrame, DataFrame]:
    """(file, value): each top-level member of the JSON object in a file as an object of its own; and the files torn off.

    Files are cut at every comma and so split over tasks, however large. A comma ends a member where it stands outside of
    strings and one bracket deep. Both are running sums: whether a piece begins inside a string follows from the quotes before
    it, its change of depth from that. They are summed in every split for either state that the split may begin in; the sums of
    the splits before it, a row for each split, tell which of them holds. A second scan then joins the pieces.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("lineSep", ",")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    cut = reader.text(path).select(F.xxhash64(FILE_PATH).alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                   F.monotonically_increasing_id().alias("line"), "value")
    bare = cut.withColumn("bare", F.regexp_replace("value", r"(?s)\\.", ""))  # a comma is never escaped: no piece begins within a pair
    depth = lambda text: _count(text, "{[") - _count(text, "}]")
    outside = lambda text: F.regexp_replace(text, '"[^"]*("|$)', "")
    pieces = bare.select("file", "start", "line", "value", (_count(F.col("bare"), '"') % 2).alias("odd"),
                         depth(outside(F.col("bare"))).alias("if_out"),
                         depth(outside(F.regexp_replace("bare", '^[^"]*("|$)', ""))).alias("if_in"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.select("file", "start", "odd", "if_out", "if_in").mapInArrow(
        _depth_sums, "file bigint, start bigint, n_odd bigint, n_from_out bigint, n_from_in bigint")
    began_in = F.coalesce(F.sum("n_odd").over(earlier), F.lit(0)) % 2
    states = written(sums.withColumn("began_in", began_in).withColumn(
        "own", F.when(F.col("began_in") == 1, F.col("n_from_in")).otherwise(F.col("n_from_out"))).select(
        "file", "start", "began_in", "n_odd", "own", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("deep")), "json-splits", spark)
    # A file that ends inside a string or a bracket has no reading.
    torn = states.groupBy("file").agg(F.sum("n_odd").alias("quotes"), F.sum("own").alias("left")).filter("quotes % 2 = 1 OR left <> 0").select("file")
    members = _put_together(pieces, states.select("file", "start", "began_in", "deep"), ",")
    opened, closed = F.when(F.col("opens"), F.lit("")).otherwise(F.lit("{")), F.when(F.col("closes"), F.lit("")).otherwise(F.lit("}"))
    return members.select("file", F.concat(opened, "value", closed).alias("value")), torn


def _json_objects(spark: SparkSession, path: str, value_type: str, whole: bool, glob: str | None) -> DataFrame:
    """Entries of JSON objects keyed by id; unreadable objects drop out with all their entries."""
    entries = F.from_json("value", T.MapType(T.StringType(), T.DataType.fromDDL(value_type))).alias("m")
    if not whole:
        return _texts(spark, path, False, glob).select(entries).select(F.explode("m").alias("exp_id", "entry"))
    members, torn = _json_members(spark, path, glob)
    parsed = members.select("file", entries)
    unreadable = written(parsed.filter("m IS NULL").select("file").union(torn).distinct(), "json-unreadable", spark)
    bad = unreadable.count()
    if bad:
        parsed = parsed.join(F.broadcast(unreadable) if bad <= BROADCAST_SPLITS else unreadable, "file", "left_anti")
    return parsed.select(F.explode("m").alias("exp_id", "entry"))


def read_state(spark: SparkSession, path: str, whole: bool = True, glob: str | None = None) -> DataFrame:
    """Runtime state (exp_id, state VARIANT) of JSON objects keyed by experiment id.

    A file is one object, which is split over tasks at its members; only an entry has to fit a row. With ``whole=False`` each
    line is an object.
    """
    return _json_objects(spark, path, "variant", whole, glob).withColumnRenamed("entry", "state")


def state_columns(state: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Promote state fields to typed columns (name → type), missing ones NULL."""
    return state.select("exp_id", *[F.try_variant_get("state", f"$.{f}", kind).alias(f) for f, kind in fields.items()])


@F.pandas_udf(T.StringType())
def yaml_to_json(bodies: pd.Series) -> pd.Series:
    """YAML documents as JSON text, NULL for unreadable ones."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def convert(body: str | None) -> str | None:
        try:
            return json.dumps(yaml.load(body, Loader=loader), default=str)
        except (yaml.YAMLError, AttributeError, TypeError):
            return None

    return bodies.map(convert)


def read_configs(spark: SparkSession, path: str, glob: str = "*.yaml", partition_key: str | None = None) -> DataFrame:
    """Configurations (exp_id, config VARIANT), the id being the file's stem.

    With ``partition_key`` it is the value of the ``key=value`` folder the file lies in.
    """
    texts = _texts(spark, path, True, glob).select("value", file_path().alias("path"))
    where = F.col("path")
    ident = dir_of(where, partition_key) if partition_key else file_stem(where)
    return texts.select(ident.alias("exp_id"), F.try_parse_json(yaml_to_json("value")).alias("config"))


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Recursive inventory: path, dir_name, file_name, mtime, length. File contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    where = file_path()
    return reader.load(path).select(
        where.alias("path"), parent_name(where).alias("dir_name"), F.col("_metadata.file_name").alias("file_name"),
        F.col(FILE_TIME).alias("mtime"), F.col("_metadata.file_size").alias("length"))


def newest_file_per_dir(files: DataFrame) -> DataFrame:
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return top_per_group(files.withColumn("_dir", folder), ["_dir"],
                         [F.col("mtime").desc(), F.col("path").desc()]).drop("_dir")


def dir_of(path: Column, partition_key: str | None = None) -> Column:
    """Directory name of a file; ``key=`` in front is cut off for written partitions."""
    name = parent_name(path)
    if partition_key is None:
        return name
    return _plain(F.regexp_replace(name, rf"^\Q{partition_key}=\E", ""))


def read_eval_rows(spark: SparkSession, path: str, schema: str | T.StructType, newest_only: bool = True,
                   partition_key: str | None = None, glob: str = "*.csv") -> DataFrame:
    """Rows of evaluation CSVs with their directory name; only the newest CSV of each directory.

    The newest files come from the inventory (metadata only) and restrict the rows by a
    semi-join, so no list of paths passes through the driver.
    """
    rows = (spark.read.schema(schema).option("header", "true").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).csv(path)
            .select("*", file_path().alias("path")))
    if newest_only:
        rows = rows.join(newest_file_per_dir(list_files(spark, path, glob)).select("path"), "path", "left_semi")
    return rows.withColumn("dir_name", dir_of(F.col("path"), partition_key)).drop("path")


#: Files whose headers are sent to all tasks; more are joined by path.
BROADCAST_HEADERS = 100_000


def _csv_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, start, line, value, raw): the lines of CSV files with the place of their split in the file and in the order of the scan."""
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(path))
    return lines.select(F.xxhash64(FILE_PATH).alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "\r$", "").alias("value"), F.col(FILE_PATH).alias("raw"))


def _odd_quotes(value: Column) -> Column:
    return (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2


def _csv_records(lines: DataFrame, ordered: bool) -> DataFrame:
    """(file, value): the lines put together where a quoted value goes over several.

    A record begins where the quotes before it in the file are even: the sums of the splits before its own, a row for each split,
    tell how a split begins.
    """
    pieces = lines.select("file", "start", "line", "value", _odd_quotes(F.col("value")).alias("odd"), F.lit(0).alias("if_out"), F.lit(0).alias("if_in"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = written(pieces.groupBy("file", "start").agg(F.sum("odd").alias("n")).select(
        "file", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) % 2).cast("bigint").alias("began_in"), F.lit(0).cast("bigint").alias("deep")),
        "csv-splits", lines.sparkSession)
    return _put_together(pieces, states, "\n", ordered).select("file", "value")


def read_eval_rows_mixed(spark: SparkSession, path: str, columns: Sequence[str], token: str = "token",
                         newest_only: bool = True, partition_key: str | None = None, glob: str = "*.csv") -> DataFrame:
    """The same for CSVs whose headers differ: columns are matched by name per file, absent ones NULL.

    The first line of each file is its header; these make a small table that meets the lines by path, so files are split over
    tasks like any text. Values follow the rules of quoted CSV; a quoted value may hold commas and line breaks. Only lines of
    files with a value over several lines are brought in order again.
    """
    lines = _csv_lines(spark, path, glob)
    # Headers, and which files have values over several lines, come from one scan.
    headers = lines.groupBy("file", "raw").agg(F.min(F.when(F.col("start") == 0, F.struct("line", "value"))).alias("h"),
                                               F.max(_odd_quotes(F.col("value"))).alias("torn")).filter("h IS NOT NULL")
    headers = headers.select("file", _plain(F.col("raw")).alias("path"), F.col("h.line").alias("header_line"), F.col("h.value").alias("header"), "torn")
    if newest_only:
        headers = headers.join(newest_file_per_dir(list_files(spark, path, glob)).select("path"), "path", "left_semi")
    own = written(headers, "csv-headers", spark)
    facts = own.agg(F.count("*").alias("files"), F.max("torn").alias("torn"), F.min("torn").alias("all_torn"), F.max(
        F.length("header") - F.length(F.replace("header", F.lit(","), F.lit("")))).alias("commas")).first()
    width = (facts["commas"] or 0) + 1
    schema, options = ", ".join(f"c{k} string" for k in range(width)), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}

    def cells(line: str) -> Column:
        parsed = F.from_csv(line, F.lit(schema), options)
        return F.array(*[parsed[f"c{k}"] for k in range(width)])

    few = facts["files"] <= BROADCAST_HEADERS
    sent = F.broadcast if few else (lambda t: t)
    names = own.select("file", "path", cells("header").alias("_names"))
    body = lines.drop("raw").join(sent(own.select("file", "header_line", "torn")), "file").filter(F.col("line") != F.col("header_line"))
    records = body.filter("torn = 0").select("file", "value")
    if facts["torn"]:
        whole = _csv_records(body.filter("torn = 1"), few)
        records = whole if facts["all_torn"] else records.unionByName(whole)
    rows = records.filter("value <> ''").join(sent(names), "file").select("path", "_names", cells("value").alias("_cells"))

    def named(name: str) -> Column:
        at = F.array_position("_names", F.lit(name))
        return F.when(at > 0, F.nullif(F.try_element_at("_cells", F.nullif(at, F.lit(0)).cast("int")), F.lit("")))

    return rows.select(dir_of(F.col("path"), partition_key).alias("dir_name"), named(token).alias(token),
                       *[named(c).try_cast("double").alias(c) for c in columns])


def read_json_results(spark: SparkSession, path: str, schema: str | T.StructType, multi_line: bool = True,
                      glob: str = "*.json") -> DataFrame:
    return (spark.read.schema(schema).option("multiLine", str(multi_line).lower())
            .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path)
            .select("*", file_path().alias("path")))


#: Folders of scope results that are listed and read at once.
FOLDERS_AT_ONCE = 10_000


def read_scopes(spark: SparkSession, path: str, metrics: Sequence[str] = ("NC", "DAC", "EP", "TTC", "C"), key: str = "exp_id") -> DataFrame:
    """All rows of the per-scope CSVs of ``export_scopes``, as texts behind the key of their folder.

    An index of all files would grow in the driver with the number of experiments, several KB each. Here it holds the folders'
    names, and an index of ``FOLDERS_AT_ONCE`` folders at a time, whose rows go to a table.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "*=*"))
    folders = spark._jvm.scala.runtime.ScalaRunTime.genericWrapArray(spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found))
    parts = [folders.slice(at, at + FOLDERS_AT_ONCE).mkString("\n") for at in range(0, len(found), FOLDERS_AT_ONCE)]
    del found, folders
    kinds = {c: T.StringType() for c in [key, "City", "Scenarios", "PDMS", *metrics, "Status"]}
    schema = T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])
    out, own = shared_dir(spark, "scope-files"), spark.newSession()
    # By default every folder is listed in a task of its own.
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(8 * spark.sparkContext.defaultParallelism))
    own.createDataFrame([], schema).write.parquet(out)
    for part in parts:
        # The schema that is given has the file's columns first, as its header has them.
        rows = own.read.schema(T.StructType([*schema.fields[1:], schema.fields[0]])).option("header", "true").option("basePath", path).csv(part.split("\n"))
        # A task keeps something of every file it read, so many tasks read and few write.
        rows.select(*kinds).hint("rebalance").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def read_logs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole log texts with path and modification time; bad bytes become replacement characters."""
    return _texts(spark, path, True, glob).select(
        file_path().alias("path"), F.col(FILE_TIME).alias("mtime"), "value")


def read_log_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, start, line, value): the lines of log files, however large; (start, line) is their order within a file.

    Files are split over tasks. ``start`` is the byte at which a line's split begins, ``line`` rises within a split.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(file_path().alias("path"), F.col("_metadata.file_block_start").alias("start"),
                                    F.monotonically_increasing_id().alias("line"), "value")


def read_scalars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Training scalars (exp_id, tag, step, value) in long form."""
    schema = "exp_id string, tag string, step bigint, value double"
    reader = spark.read.schema(schema)
    return (reader.option("header", "true") if fmt == "csv" else reader).format(fmt).load(path)


# Fields of the two queue listings; the number is the least a line must have.
QUEUE_PIPE = (["job_id", "raw_state", "name", "partition", "runtime", "time_limit"], 6)
QUEUE_SPACES = (["job_id", "partition", "name", "state", "time", "nodes", "nodelist"], 4)


def parse_queue(lines: DataFrame, style: str = "pipe", value: str = "value") -> DataFrame:
    """Queue lines as columns; short lines are skipped. The pipe form also gets a normalised state."""
    names, least = QUEUE_PIPE if style == "pipe" else QUEUE_SPACES
    parts = F.split(F.col(value), r"\|") if style == "pipe" else F.split(F.trim(F.col(value)), r"\s+")
    fields = lines.select(parts.alias("_p")).filter(F.size("_p") >= least)
    absent = F.lit("")
    columns = [F.coalesce(F.try_element_at("_p", F.lit(i)), absent).alias(n) for i, n in enumerate(names, start=1)]
    queue = fields.select(*columns)
    if style == "pipe":
        queue = queue.withColumn("state", job_state(F.col("raw_state"), F.lower("raw_state")))
    return queue


def read_queue(spark: SparkSession, path: str, style: str = "pipe") -> DataFrame:
    return parse_queue(spark.read.text(path), style)


def read_registry(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Checkpoint registrations, one row each, with their position in the experiment's list."""
    entry = "array<struct<path:string,registered_at:string,epoch:int,metrics:map<string,double>>>"
    lists = _json_objects(spark, path, entry, whole, None)
    return lists.select("exp_id", F.posexplode("entry").alias("pos", "_e")).select("exp_id", "pos", "_e.*")


TELEMETRY_SCHEMA = "timestamp string, name string, util_gpu string, util_mem string, mem_used string, mem_total string"


def telemetry_numbers(raw: DataFrame) -> DataFrame:
    """Telemetry text columns as numbers: the ``%`` and ``MiB`` units are cut off."""

    def number(column: str) -> Column:
        return F.nullif(F.regexp_extract(F.col(column), r"([0-9.]+)", 1), F.lit("")).try_cast("double").alias(column)

    stamp = F.try_to_timestamp(F.regexp_replace("timestamp", "/", "-"))
    return raw.select(stamp.alias("timestamp"), F.trim("name").alias("name"),
                      *[number(c) for c in ("util_gpu", "util_mem", "mem_used", "mem_total")])


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return telemetry_numbers(spark.read.schema(TELEMETRY_SCHEMA).option("header", "true")
                             .option("ignoreLeadingWhiteSpace", "true").csv(path))


REQUIRED_ANALYSIS_FIELDS = ["name", "exp_config", "checkpoint"]


def read_analysis_definition(spark: SparkSession, path: str, glob: str | None = "*.yaml", strict: bool = False,
                             whole: bool = True) -> DataFrame:
    """Experiments of analysis definitions, one row each; missing required fields are named in ``error``.

    ``strict`` fails the query instead. ``whole=False`` reads one definition per line.
    """
    texts = _texts(spark, path, whole, glob).select("value", file_path().alias("path"))
    body = texts.select("path", F.try_parse_json(yaml_to_json("value")).alias("d"))
    items = body.select(
        "path", F.try_variant_get("d", "$.pipeline_name", "string").alias("analysis"),
        F.posexplode_outer(F.try_variant_get("d", "$.experiments", "array<variant>")).alias("position", "e"))
    fields = [*REQUIRED_ANALYSIS_FIELDS, "output_subdir"]
    rows = items.select("path", "analysis", "position",
                        *[F.try_variant_get("e", f"$.{f}", "string").alias(f) for f in fields])
    absent = [F.when(F.coalesce(F.col(f), F.lit("")) == "", F.lit(f)) for f in REQUIRED_ANALYSIS_FIELDS]
    lacking = F.concat_ws(", ", *absent)
    error = F.when(lacking != "", F.concat(F.lit("missing: "), lacking))
    if strict:
        error = F.when(lacking != "", F.raise_error(F.concat(F.lit("missing: "), lacking)).cast("string"))
    return rows.withColumn("error", error)
