"""Reading that keeps what it cannot read.

One scan gives good rows and a table of rejected ones (source, offset, reason, record); their numbers
add up to what was read.  A share of rejects above the limit stops the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import saved

_BAD = "_rejected"


def _split(read: DataFrame, most: float, reason: str) -> tuple[DataFrame, DataFrame]:
    n, bad = read.agg(F.count(F.lit(1)), F.count(_BAD)).first()
    if n and bad / n > most:
        raise ValueError(f"{bad} of {n} rows cannot be read, more than a share of {most}")
    rejected = read.filter(F.col(_BAD).isNotNull()).select(F.col("_source").alias("source"), F.col("_offset").alias("offset"), F.lit(reason).alias("reason"), F.col(_BAD).alias("record"))
    return read.filter(F.col(_BAD).isNull()).drop(_BAD, "_source", "_offset"), rejected


def read_checked(spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "json", most: float = 0.1, **options) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of JSON lines or CSV files; blank JSON lines are neither.

    The offset is the start of the file's block that the record is in.
    """
    full = T.StructType([*spark.createDataFrame([], schema).schema.fields, T.StructField(_BAD, T.StringType())])
    reader = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).options(**options)
    if kind == "csv":
        reader = reader.option("header", True).option("quote", '"').option("escape", '"')
    raw = reader.format(kind).load(path)
    read = saved(raw.select("*", F.col("_metadata.file_path").alias("_source"), F.col("_metadata.file_block_start").alias("_offset")))
    return _split(read, most, f"no {kind} record of the schema")


def read_frames(spark: SparkSession, path: str, decode: Callable[[bytes], object] | None = None, gray: bool = True, crop: bool = False, limit: int = 250_880, most: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(frames (path, width, height, pixels binary), rejected (source, offset, reason, record)) of image files.

    Without ``decode`` Spark's own decoder reads them; with it, a function from a file's bytes to (height, width,
    channels) bytes, red-green-blue or one channel, that raises where it cannot.  Gray frames keep their size; colour ones are scaled
    down to ``limit`` pixels.  Spark bounds a batch by bytes, frames are taken one by one, and pixels leave as bytes.
    A rejected file keeps its name and length, for a later run; its bytes are not copied.
    """
    import numpy as np

    from ..operators import frames as fr

    def laid_out(px) -> tuple[int, int, bytes]:
        if px.ndim != 3 or not px.size or px.shape[2] not in (1, 3, 4):
            raise ValueError(f"no frame has the shape {px.shape}")
        px = fr.cropped(px) if crop else px
        if not px.size:
            raise ValueError("nothing is left of the frame")
        if gray:
            px = fr.luma(px)[:, :, None]
        else:
            px = np.repeat(px, 3, 2) if px.shape[2] == 1 else px[:, :, 2::-1]
            h, w = px.shape[:2]
            if h * w > limit:
                scale = (limit / (h * w)) ** 0.5
                px = fr.scaled(np.ascontiguousarray(px), max(1, int(h * scale)), max(1, int(w * scale)))
        return px.shape[1], px.shape[0], np.ascontiguousarray(px).tobytes()

    def rows(names, frames):
        import pyarrow as pa

        for name, load in zip(names, frames, strict=True):
            try:
                width, height, data = laid_out(load())
                row = (name, width, height, data, None)
            except Exception as e:  # a frame that cannot be read is a reject, whatever the decoder raises
                row = (name, None, None, None, f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=["path", "width", "height", "pixels", _BAD])

    def native(batches):
        for b in batches:
            image = {n: b.column(n) for n in ("origin", "width", "height", "nChannels", "data")}

            def one(i):
                h, w, c = (image[n][i].as_py() for n in ("height", "width", "nChannels"))
                if not h or h < 0:
                    raise ValueError("not decoded")
                return np.frombuffer(image["data"][i].as_buffer(), dtype=np.uint8).reshape(h, w, c)

            yield from rows(image["origin"].to_pylist(), [lambda i=i, one=one: one(i) for i in range(b.num_rows)])

    def given(batches):
        for b in batches:
            def one(i, b=b):
                px = np.asarray(decode(b.column("content")[i].as_py()), dtype=np.uint8)
                px = px[:, :, None] if px.ndim == 2 else px
                return px if px.shape[2] == 1 else px[:, :, 2::-1]  # blue-green-red inside, as Spark's

            yield from rows(b.column("path").to_pylist(), [lambda i=i, one=one: one(i) for i in range(b.num_rows)])

    schema = f"path string, width int, height int, pixels binary, {_BAD} string"
    if decode is None:
        read = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*").mapInArrow(native, schema)
    else:
        read = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(given, schema)
    read = saved(read)
    n, bad = read.agg(F.count(F.lit(1)), F.count(_BAD)).first()
    if n and bad / n > most:
        raise ValueError(f"{bad} of {n} frames cannot be read, more than a share of {most}")
    rejected = read.filter(F.col(_BAD).isNotNull()).select(F.col("path").alias("source"), F.lit(0).cast("long").alias("offset"), F.col(_BAD).alias("reason"), F.lit(None).cast("string").alias("record"))
    return read.filter(F.col(_BAD).isNull()).drop(_BAD), rejected
