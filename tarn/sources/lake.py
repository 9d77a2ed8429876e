"""Lakes: folders of delimited or Parquet files as tables of strings.

``<root>/<table>/<file>`` or ``<root>/<table>/<k>=<v>/.../<file>``.  Columns of text files
are ``column0``, ``column1``, ...; partition keys are columns too.  All values are strings,
an empty cell is an empty string, and nothing is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.query import QueryError

SEPARATOR = "|"


@dataclass
class LakeTable:
    """A table of the lake: its folder, partition keys in order, and format (text or parquet)."""

    name: str
    path: str
    keys: tuple[str, ...] = ()
    format: str = "text"
    width: int | None = None


def _listing(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(name, path, is a folder) of what is in a folder and not hidden by a dot, by name; of any file system that Hadoop reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    rows = [(s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in found]
    return sorted(x for x in rows if not x[0].startswith("."))


def _files(spark: SparkSession, path: str) -> list[list[str]]:
    """The folders and names, below a table's folder, of its files.  Spark lists large tables on the executors."""
    found = spark.read.schema("value string").option("recursiveFileLookup", "true").text(path).inputFiles()
    depth = urlsplit(path).path.rstrip("/").count("/") + 1
    return [[unquote(x) for x in urlsplit(f).path.split("/")[depth:]] for f in found]


def _branch(spark: SparkSession, path: str) -> list[str]:
    """The first branch of folders of a table without files."""
    out: list[str] = []
    while folders := [x for x in _listing(spark, path) if x[2] and not x[0].startswith("_")]:
        out.append(folders[0][0])
        path = folders[0][1]
    return out


def _keys(spark: SparkSession, path: str) -> tuple[tuple[str, ...], str]:
    """The partition keys of a table's folder, and the format of its files; an error if any of its files has others."""
    files = _files(spark, path)
    branches = {tuple(f.partition("=")[0] if f.count("=") == 1 else None for f in own[:-1]) for own in files} or {tuple(x.partition("=")[0] for x in _branch(spark, path))}
    if any(None in keys for keys in branches):
        raise QueryError(f"{path}: folders of a partitioned table are named key=value, with one key")
    beside = files and () in branches and any(x[2] and not x[0].startswith("_") for x in _listing(spark, path))
    if beside or len({len(keys) for keys in branches}) > 1:
        raise QueryError(f"{path} has both files and folders")
    if len(branches) > 1:
        raise QueryError(f"{path} is partitioned by {' or '.join('/'.join(x) for x in sorted(branches))}")
    parquet = {own[-1].endswith(".parquet") for own in files}
    if len(parquet) > 1:
        raise QueryError(f"{path} has both Parquet and other files")
    return branches.pop(), "parquet" if parquet == {True} else "text"


def read_parquet(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A Parquet file or folder; partition keys are strings as written in the folders' names, whatever they look like."""
    own = spark.read.option("recursiveFileLookup", "true").parquet(path).schema.fields if keys else None
    if own is None:
        return spark.read.parquet(path)
    return spark.read.schema(T.StructType([*(f for f in own if f.name not in keys), *(T.StructField(k, T.StringType()) for k in keys)])).parquet(path)


#: Lines at the head of a table that tell its width.
HEAD = 1000


def read_text(spark: SparkSession, path: str, keys: tuple[str, ...] = (), width: int | None = None, head: int | None = None) -> DataFrame:
    """A delimited file or folder as ``column0 ...`` and the partition keys, all strings.

    Rows end with LF or CRLF (a lone CR is data); the last one needs no end.  There is no
    quoting and no header.  ``width`` is the number of columns; by default that of the
    widest row, which takes a pass over the data, or with ``head`` of the widest of the
    first so many lines; a wider row that is read later is an error then.  Cells that a
    row lacks are ''.
    """
    fields = [T.StructField("value", T.StringType()), *(T.StructField(k, T.StringType()) for k in keys)]
    # With the keys in the schema, '01' stays '01' and '9' > '10', whatever the session infers.
    raw = spark.read.schema(T.StructType(fields)).option("lineSep", "\n").text(path)
    line = F.regexp_replace("value", r"\r\z", "")
    if width is None:
        cut = F.length("value") - F.length(F.replace("value", F.lit(SEPARATOR), F.lit("")))
        width = ((raw.limit(head) if head else raw).agg(F.max(cut)).first()[0] or 0) + 1
    else:
        head = None
    found = F.split(line, r"\|", -1)
    if head:
        found = F.when(F.size(found) <= width, found).otherwise(F.raise_error(F.lit(f"{path} has rows of more than the {width} cells at its head; its width must be given")))
    cells = raw.select(found.alias("_cells"), *(F.col(f"`{k}`") for k in keys))
    return cells.select(*(F.coalesce(F.get("_cells", F.lit(i)), F.lit("")).alias(f"column{i}") for i in range(width)), *(F.col(f"`{k}`") for k in keys))


def as_text(df: DataFrame, name: str, nulls: bool = False) -> Column:
    """A column compared as text: strings as they are, whole numbers in decimal, dates and times as yyyy-MM-dd.

    ``nulls``: the column may have nulls, which count as empty strings (this keeps the
    filter from being pushed into the scan).
    """
    if name not in df.columns:
        raise QueryError(f"no column {name!r}; there are {', '.join(df.columns)}")
    col, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        col = F.date_format(col, "yyyy-MM-dd")
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        col = col.cast("string")
    elif not isinstance(kind, T.StringType):
        raise QueryError(f"column {name!r} is {kind.simpleString()}, which has no single form as text")
    return F.coalesce(col, F.lit("")) if nulls else col


@dataclass
class Catalog:
    """Tables by name: those of a lake, and frames put in by hand."""

    spark: SparkSession
    tables: dict[str, LakeTable] = field(default_factory=dict)
    #: What was wrong with a table; the others can be used.
    errors: dict[str, str] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, name: str, df: DataFrame, keys: tuple[str, ...] = ()) -> None:
        self.frames[name] = df
        self.tables[name] = LakeTable(name, "", keys, "frame")

    def table(self, name: str) -> DataFrame:
        if name in self.errors:
            raise QueryError(f"table {name!r}: {self.errors[name]}")
        if name not in self.tables:
            raise QueryError(f"no table {name!r}; there are {', '.join(sorted(self.tables)) or 'none'}")
        if name not in self.frames:
            t = self.tables[name]
            self.frames[name] = read_parquet(self.spark, t.path, t.keys) if t.format == "parquet" else read_text(self.spark, t.path, t.keys, t.width, HEAD)
        return self.frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self.tables))


def discover(spark: SparkSession, root: str, widths: dict[str, int] | None = None) -> Catalog:
    """The tables of a lake: every folder in ``root`` that a dot doesn't hide.  A bad table doesn't keep the others from use."""
    catalog = Catalog(spark)
    for name, path, folder in _listing(spark, root):
        if not folder:
            continue
        try:
            keys, kind = _keys(spark, path)
            catalog.tables[name] = LakeTable(name, path, keys, kind, (widths or {}).get(name))
        except QueryError as e:
            catalog.errors[name] = str(e)
    return catalog


def to_parquet(df: DataFrame, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Load once, query many: the table as Parquet, by the same keys, read back with all columns as strings."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_text(df: DataFrame, path: str, keys: tuple[str, ...] = (), end: str = "\r\n") -> None:
    """A table of strings as delimited text, by partition keys."""
    own = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns if c not in keys]
    df.select(F.concat_ws(SEPARATOR, *own).alias("value"), *keys).write.mode("overwrite").partitionBy(*keys).option("lineSep", end).text(path)
