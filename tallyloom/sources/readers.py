"""Readers. Schemas are explicit, so no reader scans a file to guess types."""
from __future__ import annotations

import csv
import os
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import normalise_line_breaks
from ..plans.small import literal_table

# The columns of the rule tables, by kind.
RULE_SCHEMAS = {
    "note": "ori_item string, note_item string, value int, add_output string",
    "muti_note": "note_item string, ori_item string",
    "range": "var string, min double, max double, special_code string",
    "muti": "muti_item string, max int",
    "skip": "triggerA string, triggerB string, condition string, description string, "
            "output string, skip_num string, skip_str string",
    "skip2": "triggerA string, triggerB string, condition string, description string, "
             "output string, skip_num string, skip_str string",
    "logic": "check_no string, var_list string, check_rule string, TorF string, "
             "description string, out_var string",
}
FINDINGS_SCHEMA = ("survey string, no string, id long, content string, reason string, "
                   "reply string, note string, survey_code string, wave string")
REPORT_SCHEMA = "no string, id string, content string, reason string, reply string"


def _typed(df: DataFrame, schema: str, where) -> DataFrame:
    """The columns of ``schema`` by name, in any order; further ones are left out. A cell that does not fit its type is an
    error, not a NULL."""
    fields = T._parse_datatype_string(schema).fields
    absent = [f.name for f in fields if f.name not in df.columns]
    if absent:
        raise ValueError(f"{where}: no column {absent}, only {df.columns}")

    def fitting(name: str, kind: T.DataType) -> Column:
        c = F.col(f"`{name}`")
        if df.schema[name].dataType == kind:
            return c
        value, text = c.try_cast(kind), F.trim(c.cast("string"))
        message = F.concat(F.lit(f"{where}: {name} is no {kind.simpleString()}: "), text)
        return F.when(c.isNotNull() & (text != "") & value.isNull(), F.raise_error(message).cast(kind)).otherwise(value)

    return df.select(*[fitting(f.name, f.dataType).alias(f.name) for f in fields])


_EMPTY = "\x01"  # stands for a quoted empty field while a CSV file is read; an unquoted one is NULL
_CSV = {"header": True, "escape": '"', "mode": "FAILFAST", "enforceSchema": False, "emptyValue": _EMPTY}


def _quoted_empty(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.col(f"`{f.name}`") != _EMPTY, F.col(f"`{f.name}`")).when(F.col(f"`{f.name}`") == _EMPTY, "").alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def _read(spark: SparkSession, path: str, schema: str, fmt: str, line_breaks: bool = True) -> DataFrame:
    """A table by its column names. ``line_breaks``: CSV cells may hold some, so a file is not split."""
    if fmt == "csv":  # every file must have the same header
        df = _quoted_empty(spark.read.options(**_CSV, multiLine=line_breaks).csv(path))
    elif fmt == "json":
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        df = spark.read.format(fmt).load(path)
    return _typed(df, schema, path)


def read_rules(spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv") -> dict[str, DataFrame]:
    """Rule tables by kind (note, muti_note, range, muti, skip, skip2, logic)."""
    unknown = set(paths) - set(RULE_SCHEMAS)
    if unknown:
        raise ValueError(f"unknown rule kinds: {sorted(unknown)}")
    return {kind: _read(spark, path, RULE_SCHEMAS[kind], fmt) for kind, path in paths.items()}


def read_lookup_list(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """(id, item) pairs for ``multi_search``; their files are split, as they grow with the questions asked."""
    return _read(spark, path, "id long, item string", fmt, line_breaks=False)


def _literal(text: str) -> str:
    """The text as a part of a path pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", text)


def _matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match, in order, on any file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def read_handled_reports(spark: SparkSession, root: str, survey_code: str, handler: str,
                         fmt: str = "csv") -> DataFrame:
    """Handled reports of all weeks of one survey and handler; no rows before the first one exists.

    Expects ``<root>/wNN_檢誤報表*/<survey_code>_問卷檢誤_wNN_<date>_<handler>*.<fmt>``; a report
    can be a file or a folder of part files, with more columns than the five that are read. Line breaks in ``content``
    are normalised. Choose ``parquet`` or ``json`` for big reports: CSV files with line breaks are not split.
    """
    pattern = (f"{root.rstrip('/')}/w[0-9][0-9]_檢誤報表*/{_literal(survey_code)}_問卷檢誤_w[0-9][0-9]_*_"
               f"{_literal(handler)}*.{fmt}")
    named = re.compile(rf"/(w\d{{2}})_檢誤報表[^/]*/{re.escape(survey_code)}_問卷檢誤_\1_\d+_{re.escape(handler)}[^/]*\.{fmt}$")
    paths = [p for p in _matching(spark, pattern) if named.search(p)]
    if not paths:
        return spark.createDataFrame([], REPORT_SCHEMA)
    literal = [_literal(p) for p in paths]
    if fmt == "csv":
        reports = [_typed(_quoted_empty(spark.read.schema(", ".join(f"`{c}` string" for c in columns)).options(**_CSV, multiLine=True).csv(
            [_literal(p) for p in group])), REPORT_SCHEMA, group) for columns, group in _by_header(spark, paths).items()]
    elif fmt == "json":
        reports = [spark.read.schema(REPORT_SCHEMA).option("mode", "FAILFAST").json(literal)]
    else:
        reports = [_typed(spark.read.option("mergeSchema", True).format(fmt).load(literal), REPORT_SCHEMA, paths)]
    return reduce(DataFrame.unionByName, reports).withColumn("content", normalise_line_breaks(F.col("content")))


def _by_header(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The CSV files or folders by the names in their first line, so that those with one header are read by one scan. The driver reads a
    line of each and no more; that all parts of a folder agree is checked when they are read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    groups: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.getFileStatus(path).isDirectory():
            parts = [f.getPath() for f in fs.listStatus(path) if f.getLen() and not f.getPath().getName().startswith(("_", "."))]
        else:
            parts = [path]
        line = None
        if parts:
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(parts[0]), "UTF-8"))
            line = reader.readLine()
            reader.close()
        columns = tuple(next(csv.reader([line or ""]), []))
        absent = [f.name for f in T._parse_datatype_string(REPORT_SCHEMA).fields if f.name not in columns]
        if absent:
            raise ValueError(f"{p}: no column {absent}, only {list(columns)}")
        groups.setdefault(columns, []).append(p)
    return groups


# Names that Spark's reader would unpack
_PACKED = ("gz", "gzip", "bz2", "deflate", "lz4", "snappy", "zst", "zstd")
_READ_BYTES = 16 * 1024 * 1024  # what a batch of texts holds, or one text if that is longer


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path as driver and executors open it, if it lies in a mounted file system (``file:``); else None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(where).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _folders(folder: str) -> Iterator[str]:
    """A folder and, at any depth, those of partitions (``name=value``) in it."""
    yield folder
    with os.scandir(folder) as entries:
        inner = [e.path for e in entries if "=" in e.name and not e.name.startswith(".") and e.is_dir()]
    for path in inner:
        yield from _folders(path)


def _names(batches: Iterator[pa.RecordBatch], named: re.Pattern) -> Iterator[pa.RecordBatch]:
    """The files of every folder that are not hidden, not empty and named so."""
    for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
        paths: list[str] = []
        with os.scandir(folder) as entries:
            for e in entries:
                if not e.name.startswith(("_", ".")) and named.fullmatch(e.name) and e.is_file() and e.stat().st_size:
                    paths.append(e.path)
                if len(paths) >= 10_000:
                    yield pa.record_batch([pa.array(paths, pa.string())], ["path"])
                    paths = []
        yield pa.record_batch([pa.array(paths, pa.string())], ["path"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name and content of every file; names are written as Spark's reader does, with ``%20`` for a space."""
    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["file", "text"])

    for batch in batches:
        names, texts, size = [], [], 0
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as f:
                texts.append(f.read())
            names.append(re.sub(r"[\x00-\x9f]|\s", lambda m: quote(m[0], safe="!~'()*,;:$&+=@"), os.path.basename(path)))
            size += len(texts[-1])
            if size >= _READ_BYTES:
                yield out()
                names, texts, size = [], [], 0
        yield out()


def read_syntax_files(spark: SparkSession, folder: str, glob: str = "*.sps") -> DataFrame:
    """(file, text), one row per syntax file that is not empty.

    In a mounted folder the tasks list and open the files, a few microseconds each, and the driver sees the names of folders only. Other file
    systems, patterns beyond ``*`` and ``?`` and packed files go through Spark's reader, which takes milliseconds a file and lists them all
    on the driver."""
    path, ending = mounted(spark, folder), re.search(r"\.(\w+)$", glob)
    if path and os.path.isdir(path) and ending and ending[1].lower() not in _PACKED and not re.search(r"[][{}^\\]", glob):
        named = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob), re.DOTALL)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        folders = literal_table(spark, [(f,) for f in _folders(path)], "path string")
        paths = folders.repartition(parts, "path").mapInArrow(lambda batches: _names(batches, named), "path string")
        files = paths.repartition(parts, "path").mapInArrow(_contents, "file string, text binary")
        return files.select("file", F.col("text").cast("string").alias("text"))
    return (spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
            .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")))


def read_syntax_lines(spark: SparkSession, folder: str, glob: str = "*.sps") -> DataFrame:
    """(file, block, at, line): the lines of the syntax files, for ``codebook.statements_of_lines``. Long files are cut into blocks (by
    ``spark.sql.files.maxPartitionBytes``); a line belongs to the block in which it starts."""
    return (spark.read.option("pathGlobFilter", glob).text(folder)
            .select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")))


def read_findings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """What ``write_findings`` wrote. The schema keeps a wave such as ``01`` a text."""
    reader = spark.read.schema(FINDINGS_SCHEMA)
    if fmt == "csv":
        return _quoted_empty(reader.options(**_CSV, multiLine=True).csv(path))
    return reader.format(fmt).load(path)
