"""What the operators of this subpackage share: reading, folds, bounded samples and written tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
_caches: list = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read only through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int):
    """The row's fold: crc32 of the id as text, modulo ``parts``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(-1))


def at_task_end(clear):
    """Register what empties a module's cache; workers outlive tasks and stages, so what they keep must not."""
    _caches.append(clear)
    return clear


def tidy() -> None:
    """Empty the caches and give freed memory back to the system."""
    for clear in _caches:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def lean(run):
    """``run`` for mapInArrow, whose worker keeps nothing once the task has ended."""

    def whole(batches):
        from lectern.llm import common

        try:
            yield from run(batches)
        finally:
            common.tidy()

    return whole


def fresh(kept: list[str], added: list[str]) -> None:
    """Refuse columns to keep that have the name of a result's own or occur twice."""
    names = [*kept, *added]
    twice = sorted({x for x in names if names.count(x) > 1})
    if twice:
        raise ValueError(f"columns to keep clash with others: {', '.join(twice)}")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, which cuts its lineage.

    A lost executor then costs a re-read, not a recomputation. The folder goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    schema = df.schema
    del df
    release(spark)
    found = spark.read.schema(schema).parquet(path)
    found._written_to = path
    return found


def drop(*tables: DataFrame) -> None:
    """Delete what ``written`` has written, once nothing reads it any more."""
    for own in tables:
        path = own._written_to
        _remove(path, _written.pop(path))


def _remove(path: str, spark: SparkSession) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now, not when the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bitmap(ids: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """A bitmap of hashed ids, of fixed size whatever the number of ids: one false hit in many, never a miss.

    It is put together in parts by the executors; the driver gets ``bits`` / 8 bytes at most.
    """
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    parts = ids.select((at + 1).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_m"))
    size = 32768  # bits of one part
    out = np.zeros(bits // 8 + size // 8, np.uint8)
    for r in parts.collect():
        start = (r["_k"] - 1) * size // 8  # buckets count from 1, as all positions are above 0
        out[start : start + len(r["_m"])] |= np.frombuffer(bytes(r["_m"]), np.uint8)
    return out


def hit(own: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places (pmod of the hashed ids) are set."""
    return (own[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


@atexit.register
def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            _remove(path, spark)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def bounded_sample(documents: DataFrame, by: str, per_class: int, chars: int, classes: DataFrame | None = None) -> list:
    """A bounded sample of documents as rows (doc_id, ``by``, text), one an id, collected in the order of a hash of the id.

    The class ``by`` is a column of ``documents`` or of ``classes`` (doc_id, ``by``). Of each class at most ``per_class``
    documents, and no more once those before hold ``chars`` characters; a text of any length may be drawn, and is
    drawn whole. The ids of each class are counted first (by sketch), then only ids with a small enough hash travel: about
    twice as many as are wanted, whatever the size of the class. Of rows that repeat an id the least (class, text) counts.
    """
    usable = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rated = usable if classes is None else classes.where(F.col("doc_id").isNotNull())
    rated = rated.where(F.col(by).isNotNull())
    sizes = {r[0]: r[1] for r in rated.groupBy(by).agg(F.approx_count_distinct("doc_id")).collect()}  # a row a class
    if not sizes:
        return []
    full = 1 << 40
    most = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(full, 2 * (per_class + 50) * full // max(n, 1)))])
    few = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(full)) < most[F.col(by)])
    if classes is None:
        texts = lambda ids: usable.where(F.col(by).isNotNull()).join(F.broadcast(ids), "doc_id")
        sized = few.select("doc_id", by, F.length("text").alias("_n"))
    else:
        few = few.groupBy("doc_id").agg(F.min(by).alias(by))
        texts = lambda ids: usable.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
        sized = texts(few).select("doc_id", by, F.length("text").alias("_n"))
    sized = sized.groupBy("doc_id").agg(F.min(F.struct(by, "_n")).alias("_m")).select("doc_id", f"_m.{by}", "_m._n")
    order = Window.partitionBy(by).orderBy(F.xxhash64("doc_id"), "doc_id")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sized.select("doc_id", by, F.row_number().over(order).alias("_rank"), before.alias("_before"))
    chosen = ranked.where((F.col("_rank") <= per_class) & (F.col("_before") < chars))
    drawn = texts(chosen.select("doc_id") if classes is None else chosen.select("doc_id", by))
    drawn = drawn.groupBy("doc_id").agg(F.min(F.struct(by, "text")).alias("_m"))
    return drawn.select("doc_id", f"_m.{by}", "_m.text").orderBy(F.xxhash64("doc_id"), "doc_id").collect()


def blocks(texts: list, most: int):
    """Index ranges of ``texts`` whose lengths sum to about ``most``; a longer text stands alone."""
    start, total = 0, 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
