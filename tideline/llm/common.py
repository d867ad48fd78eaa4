"""What the operators share: table access, checkpoints, registration and slices of Arrow batches."""

from __future__ import annotations

import functools
import inspect
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Bytes of text that one numpy step handles at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its SQL."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Without that setting a local session (tests) uses a temporary folder of this
    machine; any other session raises, since its executors share no such folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            shared = tempfile.mkdtemp(prefix="tideline-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the session's checkpoint folder and read from there.

    It cuts the lineage as checkpoint() does, but in compressed columns and with a size that
    Spark knows when it plans joins. Files stay until the folder is cleared.
    """
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shipped(spark: SparkSession) -> None:
    """Send this package to the workers, once a session: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tideline_shipped", False):
        return
    import tempfile
    import zipfile
    from pathlib import Path

    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tideline-code-")) / "tideline_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted([package / "__init__.py", *(package / "llm").glob("*.py")]):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._tideline_shipped = True


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow with this package at hand on the workers."""
    _shipped(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_pandas(df: DataFrame, fn, schema) -> DataFrame:
    """mapInPandas with this package at hand on the workers."""
    _shipped(df.sparkSession)
    return df.mapInPandas(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows of about ``limit`` bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = batch.column(column).cast(pa.large_binary())
        ends = sizes.buffers()[1]
        offsets = np.frombuffer(ends, np.int64)[sizes.offset: sizes.offset + batch.num_rows + 1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def shielded(*roles: str):
    """Decorator of an operator on rows whose further columns pass through, whatever their names.

    ``roles`` are the operator's parameters that name columns. Inside, the columns in a role have the role's
    name and all others a name that no helper column has; outside they have their own again. A
    column that passes through under the name of an output is left out.
    """
    def wrap(operator):
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **more):
            bound = signature.bind(docs, *args, **more)
            bound.apply_defaults()
            own = {bound.arguments[r]: r for r in roles}
            inside = {c: own.get(c, f"user_column_{i}") for i, c in enumerate(docs.columns)}
            bound.arguments |= dict(zip(own.values(), own.values())) | {next(iter(signature.parameters)): docs.toDF(*inside.values())}
            out = operator(*bound.args, **bound.kwargs)
            back = {v: k for k, v in inside.items()}
            made = {c.lower() for c in out.columns if c not in back}
            kept = [c for c in out.columns if c not in back or back[c].lower() not in made]
            return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in kept])

        return run

    return wrap


def free_prefix(names: list[str]) -> str:
    """A prefix that no name starts with, in any case."""
    prefix = "_"
    while any(n.lower().startswith(prefix) for n in names):
        prefix += "_"
    return prefix


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a missing text is an empty one."""
    return [t or "" for t in batch.column(column).to_pylist()]


def with_columns(batch: pa.RecordBatch, drop: tuple[str, ...] = (), **new: pa.Array) -> pa.RecordBatch:
    """The batch with further columns; a new column replaces one of the same name."""
    kept = {n: batch.column(n) for n in batch.schema.names if n not in drop and n not in new}
    return pa.RecordBatch.from_arrays([*kept.values(), *new.values()], names=[*kept, *new])
