"""What the operators of this subpackage share: the cluster's shared folder, staged tables, batches and text kernels.

Staged tables are Parquet in the shared folder, so lineage is cut by a table that every executor can read again.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _local
    try:
        return _local
    except NameError:
        _local = "file://" + tempfile.mkdtemp(prefix="simlattice-")
        return _local


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/simlattice/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_delete_all)
    _written.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path that new_path gave, by the file system Spark has for it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


#: Rows and bytes of the batches that go to Python workers: what a worker holds is a few of them.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limits on batches to these, where they are higher."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns a reader of it.

    Shuffle files of what went into it are only removed when the driver's garbage goes, so it is collected here."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_path(spark, name)
    began = time.monotonic()
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    del df
    if time.monotonic() - began > 1:  # a quicker one leaves little
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def discard(*dfs: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for df in dfs:
        delete(df.sparkSession, df.staged_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """16 bytes that stand for a row's id and text; equal rows share it, and so share every decision."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text of each holds about max_bytes, or one row if that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row starts (one more than rows). Null is empty."""
    column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if len(column) else pa.array([], pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: ASCII capitals to small letters; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def spans(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes for which inside holds, cut at row starts: where each starts and ends, and its row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    begin = np.flatnonzero(begins)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(starts, begin, side="right") - 1


#: Longer byte ranges are hashed one by one.
_EACH = 64


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal bytes give equal hashes wherever they stand.

    Ranges are taken in eight bytes at a time, all side by side. Each step is one-to-one in the bytes and in the hash so far, and the length
    is hashed first, so ranges of up to eight bytes collide with none of their length; long ranges go through XXH3."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def step(h: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        part = eight[at] << (64 - 8 * np.minimum(left, 8)).astype(np.uint64)  # bytes beyond the range go
        return mix((h ^ part) * np.uint64(0x9FB21C651E98DF25))

    out = step(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), begin, size)
    own = np.flatnonzero(size <= _EACH)
    for k in range(8, _EACH, 8):
        own = own[size[own] > k]
        if not len(own):
            break
        out[own] = step(out[own], begin[own] + k, size[own] - k)
    for i in np.flatnonzero(size > _EACH):
        out[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes())
    return out


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of each text with A-Z lower-cased, and each word's row, in order."""
    data, starts = flat(column)
    data = LOWER[data]
    begin, end, row = spans(data, starts, ~SPACE[data])
    return hashes(data, begin, end), row


def shingles(word: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each row, distinct in their row and sorted by row and hash. A row with fewer
    words than size has one shingle of all its words."""
    n = len(word)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, n])
    place = np.arange(n) - np.repeat(first, count)
    many = np.repeat(count, count)
    acc = np.zeros(n, np.uint64)
    for k in range(size):
        ahead = np.zeros(n, np.uint64)
        ahead[: n - k] = word[k:]
        acc = np.where(place + k < many, mix(acc * np.uint64(0x100000001B3) + ahead), acc)
    use = (place + size <= many) | (place == 0)
    acc, row = acc[use], row[use]
    order = np.argsort(acc, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    acc, row = acc[order], row[order]
    keep = np.r_[True, (acc[1:] != acc[:-1]) | (row[1:] != row[:-1])]
    return acc[keep], row[keep]


#: Rows that one bucket of a rank is meant to hold.
BUCKET_ROWS = 100_000


def buckets_of(rows: int, least: int = 64) -> int:
    """How many buckets so many rows are ranked in."""
    return max(least, -(-rows // BUCKET_ROWS))


def ranked(df: DataFrame, by: list[str], order: list[str], name: str, first: Column | None = None, buckets: int | None = None) -> DataFrame:
    """Adds a gapless rank from 0 within each group of by, without bringing a group together: rows are ranked in buckets
    of order's hash, as many as the rows of df need (df is counted), and each bucket starts where the ones before it end. Lower first comes
    first; within that the order is fixed by order alone. Rows that are equal in order are interchangeable. by and order must not be null."""
    from pyspark.sql import Window

    buckets = buckets or buckets_of(df.count())

    tier = F.lit(0) if first is None else first
    df = df.withColumn("_tier", tier.cast("int")).withColumn("_bucket", F.pmod(F.xxhash64(F.lit("bucket"), *order), F.lit(buckets)).cast("int"))
    keys = [*by, "_tier", "_bucket"]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_tier", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rows = df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return rows.join(starts, keys).withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop("_tier", "_bucket", "_start", "_row")


def _places(keys: pa.Array, bits: int) -> np.ndarray:
    """Four places in a bitmap for each key of 16 bytes."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 2)
    return (mix(raw[:, :1] + raw[:, 1:] * np.arange(1, 5, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def bitmap(keys: DataFrame, column: str, max_bits: int = 1 << 27, block: int = 1 << 17):
    """A broadcast filter of the 16-byte keys of a staged table. It has max_bits at most, whatever the input; fuller, it lets more
    through that is no key. Each task sends the blocks of bits that it sets; a block is merged in one place."""
    spark = keys.sparkSession
    n = keys.count()
    bits = 1 << min(max(17, int(16 * max(1, n)).bit_length()), max_bits.bit_length() - 1)

    def set_bits(batches):
        own = np.zeros(bits, bool)
        for batch in batches:
            if batch.num_rows:
                own[_places(batch.column(column), bits).ravel()] = True
        blocks = own.reshape(-1, block)
        full = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([np.packbits(blocks[i]).tobytes() for i in full], pa.binary())], names=["block", "bits"])

    def merged(batches):
        at, total = None, None
        for batch in batches:
            for b, packed in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                if at is not None and b != at:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "bits"])
                total = np.frombuffer(packed, np.uint8) | (total if b == at else np.uint8(0))
                at = b
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "bits"])

    parts = keys.select(column).mapInArrow(set_bits, "block int, bits binary").repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        at = r["block"] * block // 8
        out[at : at + block // 8] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(out)


def maybe_among(df: DataFrame, column: str, known) -> DataFrame:
    """Rows whose key the bitmap has, and some others: a join with the keys follows, and moves few rows."""

    def run(batches):
        have = known.value
        for batch in batches:
            if batch.num_rows:
                places = _places(batch.column(column), len(have) * 8)
                hit = ((have[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=1)
                yield batch.filter(pa.array(hit))

    return df.mapInArrow(run, df.schema)
