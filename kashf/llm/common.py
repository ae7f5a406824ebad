"""What the operators share: Arrow row mapping, cuts of the lineage, dense ranks, worker caches."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

try:
    import public_tokenizers as _public
except ImportError:  # the directory is then a parameter or an environment setting of the caller
    _public = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    return _public.path(name) if _public else f"/opt/tokenizers/{name}"


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, whatever functions it is sent."""
    import sys

    return sys.__dict__.setdefault("_kashf_worker_state", {})


def give_back() -> None:
    """Hands freed memory to the system: workers live on, and what one stage has freed would be added to what the next one takes."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_bytes(t) -> bytes:
    return (t or "").encode("utf-8", "surrogatepass")


def arrow_map(df: DataFrame, fn, schema: str, rows: int = 512, setup=None, finish=None) -> DataFrame:
    """mapInArrow by slices of ``rows`` rows: ``fn(state, {column: list}) -> {column: list or array}``.

    ``finish(state)`` may return a last batch of the partition. Memory is bounded
    by one Arrow batch and the output of one slice.
    """
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def pack(got):
        return pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in out], schema=out)

    def run(batches):
        state = setup() if setup else None
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                got = fn(state, {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if got is not None:
                    yield pack(got)
        if finish:
            got = finish(state)
            if got is not None:
                yield pack(got)
        state = got = part = b = None
        give_back()

    return df.mapInArrow(run, schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names, or else one in the warehouse, which driver and executors share as well.

    A master with executors of its own must name a folder: a local warehouse would be another one on each machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if not sc.master.startswith("local[") and sc.master != "local" and base.startswith(("file:", "/")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"{base.rstrip('/')}/checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Written to the shared folder as Parquet and read again: lineage ends there, and columns can be pruned."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/kashf-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstore(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables of stored() that nothing will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/kashf-" in f:
                p = jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(conf).delete(p, True)


def dense_rank_in(df: DataFrame, keys: list[str], order: list[str], out: str, per_bucket: int = 1_000, most_buckets: int = 4_096) -> DataFrame:
    """Adds ``out``: 0, 1, 2 ... within ``keys``, without gaps, without one task ever holding a whole group.

    Rows are spread over buckets by a hash of ``order``; a window ranks inside each
    (keys, bucket), and the running counts of earlier buckets, at most
    ``most_buckets`` for a group, are added. Rows that tie in ``order`` share a bucket.
    """
    from pyspark.sql import Window as W

    buckets = min(most_buckets, max(1, df.count() // per_bucket))
    salted = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    ranked = salted.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    counts = salted.groupBy(*keys, "_b").count()
    before = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_k_b"), (F.sum("count").over(W.partitionBy(*keys).orderBy("_b")) - F.col("count")).alias("_o"))
    same = F.col("_b") == F.col("_k_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return ranked.join(before, same).select(*df.columns, (F.col("_r") + F.col("_o")).cast("long").alias(out))
