"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Only A-Z change; lower() would also change other letters."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one where none is set and the master is local, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/karst-{os.getpid()}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and every task can read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: int = 8_000_000):
    """Arrow batches of so many bytes at most go to Python workers from what runs inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts, at_once: int):
    """Neighbouring parts of an Arrow text column, each of about so many bytes at most, one text at least."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + at_once, "right")))
        yield texts.slice(i, j - i)
        i = j


def whole_groups(batches, keys: list[str]):
    """Arrow tables that hold all neighbouring rows with the same keys, from batches sorted by them."""
    import numpy as np
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            before = held[-2].column(k)[-1].as_py() if len(held) > 1 else x[0]
            new |= np.concatenate([[x[0] != before], x[1:] != x[:-1]])
        cut = np.flatnonzero(new)
        if len(cut):  # the last group may go on in the next batch
            last = int(cut[-1])
            done = pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
            held = [batch.slice(last)]
            if done.num_rows:
                yield done
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table, keys: list[str]):
    """First row of each group of neighbours with the same keys, and the number of rows at the end."""
    import numpy as np

    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many lines beneath after it as make it differ from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
