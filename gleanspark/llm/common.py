"""What several of the training-data operators need: cut points, Arrow mapping and stable hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unsigned 32-bit range, as a divisor for hashes that become fractions.
HASH_SPAN = float(2**53)

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees.

    Where that is unset, a temporary folder in local mode (as in tests), and an error on a cluster, whose
    executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="gleanspark-")
    return _own_dir[app]


class Cut:
    """A DataFrame written to the shared folder and read again: no lineage, no inherited partitioning.

    Without inherited partitioning every later join on the table gets exchanges of its own on both
    sides, which AQE may split where one key is hot.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/gleanspark-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unit_hash(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(HASH_SPAN)


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def map_arrow(df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], Iterable[list] | list]) -> DataFrame:
    """mapInArrow with a function from one record batch to the columns of one record batch."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = make(batch)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow
                )

    return df.mapInArrow(run, fields)


def to_arrow(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def kind_of(df: DataFrame, column: str) -> str:
    """The type of a column as DDL, so that ids keep theirs."""
    return df.schema[column].dataType.simpleString()


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first of name_1, name_2, ... that df has no column for (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def content_hash(df: DataFrame, *first: Column) -> Column:
    """XXH64 of all columns of a row but maps, which have no hash."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*first, *plain)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
