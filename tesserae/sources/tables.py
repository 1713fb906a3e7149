"""Readers, writers and checks for the engine's tables."""

from __future__ import annotations

import ipaddress
import json
import os
import re
import tempfile
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.perm import format_rank, is_valid, parse_answer, parse_last

SAMPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("Id", "Input_1", "Input_2", "Input_3", "Input_4", "Sentence")])
LABELLED = T.StructType([*SAMPLE.fields, T.StructField("Answer", T.StringType()), T.StructField("No_ordering", T.BooleanType())])
PREDICTION = "Id string, Answer string"
VOTE = "Id string, perm array<int>, text string"
LL = "Id string, perm array<int>, ll map<string, array<double>>"
RECORD = "Id string, fold string, images array<string>, caption string, events array<string>, rank array<int>, no_ordering boolean, cot string, caption_llm_variants array<string>, caption_aug_repeats int, caption_aug_prob double, hard_score double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out where a scan has fewer tasks than there are cores, as with one small file; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where it is unset, a local one, but only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame, **options) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet (with the writer's options) and read it back (survives lost executors)."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove saved tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    named = {"": None, "null": None, "~": None, "true": True, "false": False}
    if text.lower() in named:
        return named[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def load_config(path: str, **overrides) -> dict:
    """Nested ``name: value`` mappings by indentation, with ``- item`` and ``[a, b]`` lists and # comments; overrides that are not None win."""
    top: dict = {}
    stack: list[tuple[int, dict, str | None]] = [(-1, top, None)]  # indent, mapping, its last name
    with open(path, encoding="utf-8") as f:
        for raw in f:
            line = re.sub(r"(^|\s)#.*$", "", raw.rstrip())
            if not line.strip():
                continue
            indent = len(line) - len(line.lstrip())
            if line.lstrip().startswith("- "):
                while len(stack) > 1 and stack[-1][0] > indent:
                    stack.pop()
                _, here, name = stack[-1]
                here[name] = [*(here[name] or []), _scalar(line.lstrip()[2:])]
                continue
            while stack[-1][0] > indent or (stack[-1][0] == indent and len(stack) > 1 and stack[-1][2] is None):
                stack.pop()
            if stack[-1][0] < indent:
                _, parent, name = stack[-1]
                here = top
                if name is not None:
                    here = parent[name] = {}
                stack.append((indent, here, None))
            name, _, value = line.strip().partition(":")
            here = stack[-1][1]
            here[name] = _scalar(value)
            stack[-1] = (indent, here, name)
    return top | {k: v for k, v in overrides.items() if v is not None}


@dataclass(frozen=True)
class Paths:
    """Where the inputs and outputs lie; relative paths are joined to ``root``."""

    root: str
    train: str = "train.csv"
    test: str = "test.csv"
    train_images: str = "train"
    test_images: str = "test"
    outputs: str = "outputs"

    @classmethod
    def load(cls, config: str | None = None, root: str = ".") -> Paths:
        """The argument goes before the environment variable TESSERAE_PATHS, which goes before the defaults."""
        config = config or os.environ.get("TESSERAE_PATHS")
        found = load_config(config) if config else {}
        return cls(**({"root": root} | {k: str(v) for k, v in found.items() if k in cls.__dataclass_fields__}))

    def at(self, name: str) -> str:
        value = getattr(self, name)
        return value if os.path.isabs(value) or "://" in value else os.path.join(self.root, value)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def load_split(spark: SparkSession, split: str, paths: Paths) -> DataFrame:
    """Samples with Path_1..4 and ``paths``; split is train or test."""
    if split not in ("train", "test"):
        raise ValueError("split must be train or test")
    df = read_csv(spark, paths.at(split), LABELLED if split == "train" else SAMPLE)
    images = paths.at(f"{split}_images")
    df = df.withColumns({f"Path_{i}": F.concat_ws("/", F.lit(images), "Id", f"Input_{i}") for i in range(1, 5)})
    return df.withColumn("paths", F.array(*[F.col(f"Path_{i}") for i in range(1, 5)]))


def read_jsonl(spark: SparkSession, path: str, schema, skip_bad: bool = False) -> DataFrame:
    """One object per line; blank lines are skipped, broken ones are null rows or, with ``skip_bad``, skipped too."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_bad else "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines for .jsonl and .ndjson, else CSV."""
    return read_jsonl(spark, path, schema) if path.lower().endswith((".jsonl", ".ndjson")) else read_csv(spark, path, schema)


def hard_lookup(rows: DataFrame, fields: list[str], order: str = "pos") -> DataFrame:
    """(Id, fields) keyed by Id or id; the last row of a key wins, blanks are null."""
    key = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("Id", "id") if c in rows.columns and not (c == "id" and "Id" in rows.columns)])
    x = rows.select(key.alias("Id"), order, *[F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c in fields]).filter("Id is not null")
    return x.groupBy("Id").agg(F.max_by(F.struct(*fields), order).alias("r")).select("Id", "r.*")


def load_votes(spark: SparkSession, path: str) -> DataFrame:
    """(id, perm, text) of a raw vote file."""
    return read_jsonl(spark, path, VOTE).withColumnRenamed("Id", "id")


def load_ll(spark: SparkSession, path: str) -> DataFrame:
    """(id, lls map<key, struct<lp, n>>) of a raw log-likelihood file."""
    raw = read_jsonl(spark, path, LL)
    return raw.select(F.col("Id").alias("id"), F.transform_values("ll", lambda _, v: F.struct(F.get(v, F.lit(0)).alias("lp"), F.get(v, F.lit(1)).cast("int").alias("n"))).alias("lls"))


def load_predictions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(id, rank); of rows that repeat an id the last in the file counts; strict raises on an answer that is no permutation, else it is null."""
    parse = parse_answer if strict else parse_last
    rows = read_csv(spark, path, PREDICTION).select(F.col("Id").alias("id"), "Answer", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at"))
    last = rows.groupBy("id").agg(F.max_by(F.struct("Answer"), "at").alias("r"))  # a CSV file is one split, read in order
    return last.select("id", parse(F.col("r.Answer")).alias("rank"))


def write_predictions(pred: DataFrame, path: str) -> None:
    pred.select(F.col("id").alias("Id"), format_rank(F.col("rank")).alias("Answer")).write.option("header", True).csv(path)


def write_metrics(row: DataFrame, path: str) -> None:
    row.write.mode("overwrite").json(path)


def pending(jobs: DataFrame, done: DataFrame, keys: list[str] = ["id", "perm"]) -> DataFrame:  # noqa: B006
    """Jobs without an output yet: resume is an anti join, the output is appended."""
    return jobs.join(done.select(*keys).distinct(), keys, "left_anti")


SHARE = (0.05, 0.30)


def submission(test: DataFrame, pred: DataFrame) -> DataFrame:
    """(pos, Id, Answer) in test order (pos, id); raises where a prediction is missing or no permutation."""
    x = test.select("pos", "id").join(pred.select("id", "rank"), "id", "left")
    ok = F.when(is_valid(F.col("rank")), F.col("rank")).otherwise(F.raise_error(F.concat(F.lit("missing or invalid prediction: "), F.col("id").cast("string"))).cast("array<int>"))
    return x.select("pos", F.col("id").alias("Id"), format_rank(ok).alias("Answer")).orderBy("pos")


def submission_report(test: DataFrame, sub: DataFrame) -> DataFrame:
    """(n, n_missing, n_invalid, n_misplaced, identity_share, share_ok) of a written submission (pos, Id, Answer)."""
    wanted, got = test.select(F.col("pos").alias("p"), F.col("id").alias("key")), sub.select("pos", F.col("Id").alias("key"), "Answer", F.lit(1).alias("there"))
    x = wanted.join(got, "key", "full")
    bad = parse_last(F.col("Answer")).isNull()
    same = F.avg(F.when(F.col("Answer") == "[1, 2, 3, 4]", 1.0).otherwise(0.0))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return x.agg(F.count(F.lit(1)).alias("n"), n(F.col("there").isNull() | F.col("p").isNull()).alias("n_missing"), n(bad).alias("n_invalid"), n(~F.col("p").eqNullSafe(F.col("pos"))).alias("n_misplaced"), F.round(same, 6).alias("identity_share"), ((same >= SHARE[0]) & (same <= SHARE[1])).alias("share_ok"))


def write_submission(test: DataFrame, pred: DataFrame, path: str) -> dict:
    """Write the CSV in test order as one part (a submission is as small as its test set), read it back and check it.

    Returns n, identity_share and share_ok; raises where the file does not hold every id in order
    with a permutation, warns where the share of identities is out of range.
    """
    submission(test, pred).orderBy("pos").select("Id", "Answer").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    spark = test.sparkSession
    back = spark.read.option("header", True).csv(path)
    if back.columns != ["Id", "Answer"]:
        raise ValueError(f"columns of the submission are {back.columns}")
    back = read_csv(spark, path, PREDICTION).withColumn("pos", F.monotonically_increasing_id())  # one part, so the row number
    ranked = with_position(test.select(F.col("pos").alias("at"), "id"), "at").select("pos", "id")
    kind = test.schema["id"].dataType
    found = submission_report(ranked, back.withColumn("Id", F.col("Id").cast(kind))).first().asDict()
    if found["n_missing"] or found["n_invalid"] or found["n_misplaced"]:
        raise ValueError(f"the written submission is wrong: {found}")
    if not found["share_ok"]:
        warnings.warn(f"share of identities {found['identity_share']} is not in {SHARE}", stacklevel=2)
    return found


def write_chunks(rows: DataFrame, path: str, size: int) -> None:
    """(pos, id, ...) as chunk=N folders of ``size`` consecutive rows; chunks that are there already stay as they are."""
    named = rows.withColumn("chunk", F.floor(F.col("pos") / size))
    spark = rows.sparkSession
    if _exists(spark, path):
        named = named.join(spark.read.parquet(path).select("chunk").distinct(), "chunk", "left_anti")
    named.repartition("chunk").write.mode("append").partitionBy("chunk").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def merge_chunks(ids: DataFrame, path: str) -> DataFrame:
    """The rows of all chunks, in order; raises where they are not exactly ids (pos, id)."""
    rows = ids.sparkSession.read.parquet(path).drop("chunk").withColumnRenamed("id", "_id")
    x = ids.select("pos", "id").join(rows, "pos", "full")
    wrong = F.raise_error(F.concat(F.lit("chunks do not match the ids at "), F.coalesce(F.col("pos").cast("string"), F.lit("?"))))
    return x.filter(F.when(F.col("id").eqNullSafe(F.col("_id")), True).otherwise(wrong.cast("boolean"))).drop("_id").orderBy("pos")


def left_total(left: DataFrame, right: DataFrame, key: str, field: str) -> DataFrame:
    """Left join that raises where ``field`` of the right side is null."""
    x = left.join(right, key, "left")
    return x.filter(F.when(F.col(field).isNotNull(), True).otherwise(F.raise_error(F.lit(f"no {field} for a key")).cast("boolean")))


def restrict(truth: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of truth whose key has an output."""
    return truth.join(ids.select(key).distinct(), key, "left_semi")


def coverage(truth: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """(n, n_covered, complete): how much of truth ``restrict`` keeps; complete is the warning's condition."""
    x = truth.select(key).join(ids.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    n, hit = F.count(F.lit(1)), F.count("_hit")
    return x.agg(n.alias("n"), hit.alias("n_covered"), (n == hit).alias("complete"))


def _images(spark: SparkSession, path: str) -> DataFrame:
    """The images Spark can decode; broken ones are dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def _pixels(row: dict):
    import numpy as np

    return np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"], row["nChannels"])


def _luma(px):
    """ITU-R 601 luma of blue-green-red bytes, or the one channel there is."""
    import numpy as np

    if px.shape[2] == 1:
        return px[:, :, 0].astype(np.int64)
    wide = px.astype(np.int64)
    return (wide[:, :, 2] * 19595 + wide[:, :, 1] * 38470 + wide[:, :, 0] * 7471 + 32768) >> 16


def read_gray(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, gray array<array<int>>)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                g = _luma(_pixels(r)).astype(np.int32)
                flat = pa.ListArray.from_arrays(np.arange(0, g.size + 1, g.shape[1], dtype=np.int32), pa.array(g.ravel()))
                whole = pa.ListArray.from_arrays(np.array([0, g.shape[0]], dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([pa.array([r["origin"]]), pa.array([r["width"]], pa.int32()), pa.array([r["height"]], pa.int32()), whole], names=["path", "width", "height", "gray"])

    return _images(spark, path).mapInArrow(run, "path string, width int, height int, gray array<array<int>>")


def read_rgb(spark: SparkSession, path: str, crop: bool = False, limit: int = 250_880) -> DataFrame:
    """(path, width, height, rgb binary): red-green-blue rows of every readable image, its dark bands cropped if asked, scaled down by area means to ``limit`` pixels."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ..operators.image import area_means

        for b in batches:
            for r in b.to_pylist():
                px = _pixels(r)
                if crop:
                    dark = _luma(px).mean(1) < 8
                    most = len(dark) // 3
                    ends = [min(most, int(np.argmin(d)) if not d.all() else len(d)) for d in (dark, dark[::-1])]
                    px = px[ends[0] : len(px) - ends[1]]
                rgb = np.repeat(px, 3, 2) if px.shape[2] == 1 else px[:, :, 2::-1]
                h, w = rgb.shape[:2]
                if h * w > limit:
                    scale = (limit / (h * w)) ** 0.5
                    h, w = max(1, int(h * scale)), max(1, int(w * scale))
                    rgb = np.stack([np.rint(area_means(rgb[:, :, c].astype(float), h, w)) for c in range(3)], 2).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([r["origin"]]), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([np.ascontiguousarray(rgb).tobytes()], pa.binary())], names=["path", "width", "height", "rgb"])

    return _images(spark, path).mapInArrow(run, "path string, width int, height int, rgb binary")


CHAT_PATH = ("chat", "completions")


def chat_url(base: str) -> str:
    """The address of chat completions under a base address, whose own path, query and end slash may be there already."""
    at = urlsplit(base)
    path = [p for p in at.path.split("/") if p]
    if tuple(path[-2:]) != CHAT_PATH:
        path += CHAT_PATH
    return urlunsplit(at._replace(path="/" + "/".join(path)))


def is_own_host(url: str) -> bool:
    """Whether the host is this machine: by name, or a loopback or unspecified address."""
    host = urlsplit(url).hostname or ""
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return host == "localhost" or host.endswith(".localhost")
    return address.is_loopback or address.is_unspecified


def chat_request(base: str, model: str, system: str, user: str, key: str = "", temperature: float = 0.7, max_tokens: int = 900, json_mode: bool = False) -> tuple[str, dict, dict]:
    """(url, headers, payload) of a chat completion; a key is needed unless the host is this machine."""
    url = chat_url(base)
    if not (key or is_own_host(url)):
        raise ValueError("a key is needed for this host")
    headers = {"Content-Type": "application/json"}
    if key:
        headers["Authorization"] = f"Bearer {key}"
    said = [{"role": role, "content": text} for role, text in (("system", system), ("user", user))]
    payload = dict(model=model, messages=said, temperature=temperature, max_tokens=max_tokens)
    return url, headers, payload | ({"response_format": {"type": "json_object"}} if json_mode else {})


def chat_content(body: str) -> str:
    """The text of a reply's first choice: a string is itself, of a list its strings and the parts of type text count, nothing is an empty text."""
    content = json.loads(body)["choices"][0]["message"].get("content")
    if content is None or isinstance(content, str):
        return content or ""
    if not isinstance(content, list):
        raise ValueError("a reply's content is neither text nor a list of parts")
    parts = [{"text": part} if isinstance(part, str) else part for part in content]
    return "".join(part["text"] for part in parts if part.get("type", "text") == "text" and part.get("text"))


def chat_caller(transport: Callable[[str, dict, bytes], str], base: str, model: str, **options) -> Callable[[str, str], str]:
    """A function for complete_text; ``transport`` sends (url, headers, body) and returns the reply's body.  Nothing here opens a connection."""

    def call(system: str, user: str) -> str:
        url, headers, payload = chat_request(base, model, system, user, **options)
        return chat_content(transport(url, headers, json.dumps(payload).encode("utf-8")))

    return call


def complete_text(prompts: DataFrame, call: Callable[[str, str], str]) -> DataFrame:
    """Adds reply to (system, user) rows by a function given by the caller; there is no default and no network use here."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            yield b.append_column("reply", pa.array([call(r["system"], r["user"]) for r in rows], pa.string()))

    return prompts.mapInArrow(run, T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType())]))


def ordered_lookup(ids: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """rows in the order of ids (pos, key); raises on an id without a row."""
    x = ids.select("pos", key).join(rows.withColumn("_there", F.lit(1)), key, "left")
    return x.filter(F.when(F.col("_there").isNull(), F.raise_error(F.lit("an id has no row")).isNotNull()).otherwise(True)).drop("_there").orderBy("pos")


def first_rows(df: DataFrame, n: int, order: str = "pos") -> DataFrame:
    return df.orderBy(order).limit(n)


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """Adds pos from 0 in the given order: rows are sorted by ranges, and the ranges counted, so no task holds the table."""
    part = F.spark_partition_id()
    x = saved(df.orderBy(*order).withColumn("_part", part))  # the ranges must not change between the passes
    sizes = x.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return x.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("pos", F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")
