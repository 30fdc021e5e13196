"""What the corpus operators share: the word pattern, table access, stored steps and rows under names that cannot clash."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's own setting by which a finished query's shuffle files go at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. A local session that names none gets a temporary folder; a cluster must name one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named)
    return named


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries that end in this block leave no shuffle files; what they computed must be stored by then."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder: a cut of its lineage, after which its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder and drop its lineage and shuffle files."""
    shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.checkpoint(eager=True)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables from ``stored`` that nothing reads any more."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def own_names(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra ones with clashing names stay out."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, beside which an operator's own names cannot clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(row: str, names: Iterable[str], changed: dict[str, Column] | None = None) -> list[Column]:
    """The columns of a struct made by :func:`whole_row`, some of them replaced."""
    changed = changed or {}
    return [changed.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in names]


def text_key(text: str = "text") -> Column:
    """A digest of a text, which tells rows of one doc_id apart (null: like empty)."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


#: Partial states merged by one task.
FAN = 32


def fan_in(states: DataFrame, parts: int, merge: Callable[[object | None, bytes], object], pack: Callable[[object], bytes], fan: int = FAN) -> DataFrame:
    """key and state: the states (key int, part long, state binary) of each key as one, merged in groups of ``fan`` parts at a time and in the order of the parts, which are numbered under ``parts``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int64()), pa.array([pack(state)], pa.binary())], names=["key", "part", "state"])
        for batch in batches:
            for i in range(batch.num_rows):
                at = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if held is not None and at != held:
                    yield out()
                    state = None
                state, held = merge(state, batch.column(3)[i].as_py()), at
        if held is not None:
            yield out()

    while parts > 1:
        parts = -(-parts // fan)
        grouped = states.select("key", F.expr(f"part div {fan}").alias("group"), "part", "state")
        states = grouped.repartition("key", "group").sortWithinPartitions("key", "group", "part").mapInArrow(join, "key int, part long, state binary")
    return states.select("key", "state")
