"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: White space of the word definitions: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: A key with more than one in HOT_SHARE of all rows is joined apart, so there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000

_own_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or else a folder in the warehouse.

    Only where driver and executors are one process, as in local tests, a temporary folder stands in. A warehouse on a machine's own
    disk is refused: other machines could not read what one of them writes there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if "://" not in warehouse or warehouse.startswith("file:"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; the warehouse {warehouse} is local")
        return f"{warehouse}/loomstone-scratch"
    if context.applicationId not in _own_scratch:
        _own_scratch[context.applicationId] = tempfile.mkdtemp(prefix="loomstone-")
    return _own_scratch[context.applicationId]


def staged(df: DataFrame, name: str, *after: DataFrame | None, group_mb: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here,
    and a lost executor costs no more than reading the table again. `after`: staged tables that df was the last to need; they are deleted.
    `group_mb`: MB of a row group, where rows are long; a batch that is read is no more than a group (100 rows at least)."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write if group_mb is None else df.write.option("parquet.block.size", group_mb << 20)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    for old in after:
        release(old)
    return out


def staged_rows(df: DataFrame, name: str, row: str = "_row") -> DataFrame:
    """staged(), where df has a struct `row` whose field names may clash in a file: there they are c0, c1, ..."""
    kind = df.schema[row].dataType
    private = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(kind.fields)])
    public = StructType([StructField(f.name, f.dataType) for f in kind.fields])
    return staged(df.withColumn(row, F.col(row).cast(private)), name).withColumn(row, F.col(row).cast(public))


def release(df: DataFrame | None) -> None:
    """Delete a staged table that nothing will read again."""
    at = getattr(df, "_staged_at", None)
    if at:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with private column names c0, c1, ... and the private name of each of its columns, so that dots, backticks, names
    that differ in case only, or names that an operator uses inside cannot clash. Names are exact; of equal ones the first counts."""
    own: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        own.setdefault(name, f"c{i}")
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), own


def packed(df: DataFrame, keep: list[str] | None = None, without: str | None = None) -> tuple[DataFrame, dict[str, str], Column]:
    """plain(df), and its columns `keep` (all by default, but not `without`) under their own names as one struct."""
    bare, own = plain(df)
    if keep is not None:
        fields = [F.col(own[name]).alias(name) for name in keep]
    else:
        fields = [F.col(f"c{i}").alias(name) for i, name in enumerate(df.columns) if name != without]
    return bare, own, F.struct(*fields or [F.lit(None).cast("string").alias("none")])


def unpacked(df: DataFrame, names: list[str], row: str = "_row") -> DataFrame:
    """The fields of the struct `row`, as columns `names`."""
    return df.select(f"{row}.*").toDF(*names)


def replaced(df: DataFrame, columns: list[str], column: str, value: str, row: str = "_row") -> DataFrame:
    """The rows of the struct `row` (columns without `column`) with `column` set to the column `value`, in the order of columns."""
    others = [c for c in columns if c != column]
    bare = df.select(F.col(value).alias("v"), f"{row}.*") if others else df.select(F.col(value).alias("v"))
    bare = bare.toDF("v", *[f"c{i}" for i in range(len(bare.columns) - 1)])
    at = iter(range(len(others)))
    return bare.select(*["v" if c == column else f"c{next(at)}" for c in columns]).toDF(*columns)


def column_or_null(df: DataFrame, own: dict[str, str], name: str, kind: str) -> Column:
    """Column `name` of a plain() table as `kind`, or nulls where it is missing."""
    return (F.col(own[name]) if name in own else F.lit(None)).cast(kind)


def join_split(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has one row for each key and in `weight` the key's number of rows.

    Keys that hold more than one in HOT_SHARE of the rows are fewer than HOT_SHARE: they are broadcast and their rows joined where they
    lie. All other rows meet on their keys. how: inner or left. Null keys meet nothing. rows should be staged: it is read twice and counted.
    """
    limit = rows.count() / HOT_SHARE
    hot = keyed.filter(F.col(weight) > limit)
    some = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.filter(F.col(weight) <= limit), on, how)
    return some.unionByName(rest)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
