"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tables_root

#: Python tasks take their rows in slices of about so many text bytes.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Intermediate Parquet tables in the shared checkpoint folder.

    ``put`` writes a frame and rereads it (lineage is cut, later branches
    read files that survive a lost executor); ``drop`` removes tables whose
    readers are done.  A table that a returned frame still reads must stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{tables_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def doc_bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null ids: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n)).cast("int")


def hash_unit(*cols: str | Column, salt: int = 0) -> Column:
    """A fixed pseudo-random number in [0, 1) from the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(salt), *cols), 11).cast("double")
            / F.lit(float(1 << 53)))


def with_text(docs: DataFrame, carry: list[str], text_col: str) -> tuple[DataFrame, int]:
    """The ``carry`` columns and the text, and the text's place among them."""
    if text_col in carry:
        return docs.select(*carry), carry.index(text_col)
    return docs.select(*carry, F.col(text_col).alias("__text")), len(carry)


def text_slices(batches: Iterator[pa.RecordBatch], text: str | int,
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of the column
    ``text`` (a single longer row makes a batch of its own)."""
    for b in batches:
        col = b.column(text)
        if b.num_rows < 2 or col.nbytes <= limit:
            if b.num_rows:
                yield b
            continue
        sizes = np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64)
        start = total = 0
        for i, s in enumerate(sizes):
            if total and total + s > limit:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += int(s)
        yield b.slice(start)


def utf8(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type)
                       else pa.binary()).to_pylist()


def arrow_schema(df_schema):
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df_schema)
