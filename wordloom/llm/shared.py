"""What the operators of this subpackage share: tables, scratch tables in the cluster's shared folder, Arrow row maps."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark types of the columns that the Arrow maps append.
ARROW = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary(), T.BooleanType(): pa.bool_()}


#: Rows in an Arrow batch between the JVM and Python.
BATCH = 1000
_OWNER: list = [None, None]


def claim(name: str, clear: Callable[[], None]) -> None:
    """Say whose tables a Python worker holds: another operator's before it are cleared, so that they never add up."""
    if _OWNER[0] != name:
        if _OWNER[1]:
            _OWNER[1]()
            gc.collect()
        _OWNER[:] = [name, clear]


def unused(columns: list[str], name: str) -> str:
    """A column name like `name` that none of these has, whatever the case."""
    taken = {c.lower() for c in columns}
    while (name := f"__{name}").lower() in taken:
        pass
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TEMPORARY: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, or a temporary one of the application where it is unset (local sessions, as in tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _TEMPORARY:
            _TEMPORARY[app] = "file://" + tempfile.mkdtemp(prefix="wordloom-")
            atexit.register(shutil.rmtree, _TEMPORARY[app][7:], True)
        base = _TEMPORARY[app]
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel in batches of at most BATCH rows, so that very long ones don't add up; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, BATCH)


_GATHERED: ContextVar[list[Scratch] | None] = ContextVar("gathered", default=None)


@contextmanager
def gathered() -> Iterator[list[Scratch]]:
    """The Scratch objects made in its body, for a caller that knows when their tables are done with."""
    made: list[Scratch] = []
    token = _GATHERED.set(made)
    try:
        yield made
    finally:
        _GATHERED.reset(token)


class Scratch:
    """Tables of one operator run, written to the shared folder so that a lost executor costs no recomputation of what came before.

    Results are lazy and read these tables, so they stay until drop(); see gathered().
    """

    def __init__(self, spark: SparkSession, name: str):
        if (made := _GATHERED.get()) is not None:
            made.append(self)
        small_batches(spark)
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of the run; call it only once no DataFrame needs it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def append_columns(df: DataFrame, uses: list[str], make: Callable[[Iterator[list[list]]], Iterator[list[list]]], fields: list[tuple[str, T.DataType]], rows: int = 1024) -> DataFrame:
    """df with the columns `fields`, made from the columns `uses` by an Arrow map.

    make(chunks) gets, for every chunk of at most `rows` rows, one Python list
    per column of `uses` and yields one list per field, in the same order.
    Columns of df that bear a new column's name are replaced; all others pass
    untouched.
    """
    small_batches(df.sparkSession)
    new = {n for n, _ in fields}
    kept = [c for c in df.columns if c not in new]
    given = list(dict.fromkeys([*kept, *uses]))
    # By number, as Spark takes no names with dots here.
    src = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(given)])
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, t) for n, t in fields]])
    types, inputs, width = [ARROW[t] for _, t in fields], [given.index(c) for c in uses], len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chunks():
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    held.append(part := batch.slice(at, rows))
                    yield [part.column(k).to_pylist() for k in inputs]

        for out in make(chunks()):
            part = held.pop()
            yield pa.RecordBatch.from_arrays([*part.columns[:width], *[pa.array(x, t) for x, t in zip(out, types)]], names=[*kept, *[n for n, _ in fields]])

    return src.mapInArrow(run, schema)
