"""Line dedup by two Bloom filters.

1. A pass over the texts hashes the distinct line keys of each document. Only 8 bytes per key and task move, to slices of
   the filters by the hash's leading bits. A slice puts its hashes into a filter of keys seen once; what is there already goes
   to a filter of keys seen twice. A hot line is one hash per task, so slices stay even.
2. A second pass probes the twice-seen filter: only lines that it suspects are counted (as 16-byte digests of their keys). A filter
   of up to max_bits bits is broadcast, and nothing else moves. A larger one stays cut by slices, as many as keep a slice small, and
   line hashes go to their slices, salted by document, so that a hot line's rows spread. False positives cost shuffle, never a
   wrong result.
3. Confirmed keys join the suspected lines; what a document loses joins the documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import row_key, slices, staged

STRIP = b" \t\n\x0b\x0c\r"
SLICES = 512
PROBES = 4
#: Bits of a slice of a filter that is not broadcast, and copies of a slice, among which documents are dealt.
SLICE_BITS, SALTS = 1 << 22, 16


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: blanks stripped at both ends, A-Z lower-cased. Null or empty text is one empty line."""
    return [x.strip(STRIP) for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places in a filter of so many bits for each hash."""
    step = (h >> np.uint64(20)) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(1, PROBES + 1, dtype=np.uint64)) >> np.uint64(7)) % np.uint64(bits)


def _slice(h: np.ndarray, slices: int = SLICES) -> np.ndarray:
    """Which of so many slices, a power of two, by the leading bits."""
    return (h >> np.uint64(65 - slices.bit_length())).astype(np.int32)


def _once_twice(min_chars: int, flush: int = 100_000):
    """Packs the distinct hashes of a task's lines: those in one document so far and those in more, by slice."""

    def pack(once: set, twice: set):
        for seen, many in ((once - twice, False), (twice, True)):
            h = np.fromiter(seen, np.uint64, len(seen))
            h.sort()
            at = np.searchsorted(_slice(h), np.arange(SLICES + 1))
            full = np.flatnonzero(np.diff(at))
            if len(full):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), many)), pa.array(np.diff(at)[full].astype(np.int64)), pa.array([h[at[i] : at[i + 1]].tobytes() for i in full], pa.binary())],
                    names=["slice", "many", "n", "hashes"],
                )

    def run(batches):
        once, twice = set(), set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = {xxhash.xxh3_64_intdigest(k) for k in line_keys(text) if len(k) >= min_chars}
                twice |= own & once
                once |= own
            if len(once) > flush:
                yield from pack(once, twice)
                once, twice = set(), set()
        yield from pack(once, twice)

    return run


def _fill(bits: int):
    """Fills the two filters of each slice (its rows come together) and returns the twice-seen one, packed."""

    def done(at, twice):
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["slice", "twice"])

    def run(batches):
        at, once, twice = None, None, None
        for batch in batches:
            for s, many, packed in zip(*(batch.column(c).to_pylist() for c in ("slice", "many", "hashes")), strict=True):
                if s != at:
                    if at is not None and twice.any():
                        yield done(at, twice)
                    at, once, twice = s, np.zeros(bits, bool), np.zeros(bits, bool)
                places = _bits(np.frombuffer(packed, np.uint64), bits)
                again = np.ones(len(places), bool) if many else once[places].all(axis=1)
                twice[places[again].ravel()] = True
                once[places.ravel()] = True
        if at is not None and twice.any():
            yield done(at, twice)

    return run


def _recut(slices: int):
    """Cuts packed hashes, which are sorted, into finer slices."""

    def run(batches):
        for batch in batches:
            for many, packed in zip(*(batch.column(c).to_pylist() for c in ("many", "hashes")), strict=True):
                h = np.frombuffer(packed, np.uint64)
                which = _slice(h, slices)
                first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
                parts = [x.tobytes() for x in np.split(h, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(which[first]), pa.array(np.full(len(first), many)), pa.array(parts, pa.binary())], names=["slice", "many", "hashes"])

    return run


def _dealt(slices: int, min_chars: int):
    """Every distinct line key of a document, with its hash's slice: one row each."""

    def run(batches):
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("slice", "hash", "rk", "key", "lines")}
            for rk, text in zip(batch.column("rk").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for k, lines in _places_of(text, min_chars).items():
                    h = xxhash.xxh3_64_intdigest(k)
                    for c, x in zip(rows, (h >> (65 - slices.bit_length()), h.to_bytes(8, "little"), rk, hashlib.md5(k).digest(), lines), strict=True):
                        rows[c].append(x)
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows.values(), kinds, strict=True)], names=list(rows))

    return run


def _probe(bits: int):
    """Rows come by slice and salt, the slice's filter first: those that it suspects."""

    def run(batches):
        at, seen = None, None
        for batch in batches:
            keep = []
            for i, (s, salt, twice, h) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("slice", "salt", "twice", "hash")), strict=True)):
                if twice is not None:
                    at, seen = (s, salt), np.frombuffer(twice, np.uint8)
                elif at == (s, salt):
                    places = _bits(np.frombuffer(h, np.uint64), bits)[0]
                    if ((seen[(places >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (places & np.uint64(7)).astype(np.uint8))) & 1).all():
                        keep.append(i)
            yield batch.select(["rk", "key", "lines"]).take(pa.array(keep, pa.int64()))

    return run


def _sliced_suspects(keyed: DataFrame, packed: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """The suspects by a filter of so many bits that stays in slices."""
    slices = max(SLICES, bits // SLICE_BITS)
    filters = packed.mapInArrow(_recut(slices), "slice int, many boolean, hashes binary").repartition("slice").sortWithinPartitions("slice")
    filters = staged(filters.mapInArrow(_fill(bits // slices), "slice int, twice binary"), "line-filters")
    copies = filters.select("slice", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "twice")
    rows = keyed.select("rk", "text").mapInArrow(_dealt(slices, min_chars), "slice int, hash binary, rk binary, key binary, lines array<int>")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rk"), F.lit(SALTS)).cast("int"))
    both = rows.unionByName(copies, allowMissingColumns=True).repartition("slice", "salt").sortWithinPartitions("slice", "salt", F.col("twice").isNull())
    return both.mapInArrow(_probe(bits // slices), "rk binary, key binary, lines array<int>")


def _places_of(text: str | None, min_chars: int) -> dict[bytes, list[int]]:
    """The lines of each key that counts."""
    where: dict[bytes, list[int]] = {}
    for i, k in enumerate(line_keys(text)):
        if len(k) >= min_chars:
            where.setdefault(k, []).append(i)
    return where


def _suspects(filters, bits: int, min_chars: int):
    """The lines of each document whose key the twice-seen filter has: one row for each distinct key of a document."""

    def run(batches):
        seen = filters.value
        for batch in batches:
            key, digest, lines = [], [], []
            for rk, text in zip(batch.column("rk").to_pylist(), batch.column("text").to_pylist(), strict=True):
                where = _places_of(text, min_chars)
                if not where:
                    continue
                own = list(where)
                h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in own), np.uint64, len(own))
                places, s = _bits(h, bits), _slice(h)
                hit = ((seen[s[:, None], (places >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (places & np.uint64(7)).astype(np.uint8))) & 1).all(axis=1)
                for k in np.flatnonzero(hit):
                    key.append(rk)
                    digest.append(hashlib.md5(own[k]).digest())
                    lines.append(where[own[k]])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(digest, pa.binary()), pa.array(lines, pa.list_(pa.int32()))], names=["rk", "key", "lines"])

    return run


def _rebuild(columns: list[str]):
    def run(batches):
        for batch in batches:
            kept, total, gone = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                out = set(drop or ())
                kept.append(text if not out else "\n".join(x for i, x in enumerate(lines) if i not in out))
                total.append(len(lines))
                gone.append(len(out))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*columns, "kept_text", "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 2, keep: str = "first", min_chars: int = 1, max_bits: int = 1 << 27, bits_per_key: int = 16) -> DataFrame:
    """Drops lines whose key stands in min_docs documents or more.

    keep="none" drops every such line; keep="first" leaves the first one: of the smallest (doc_id, row key), its first line.
    docs needs doc_id and text; its other columns pass through, but the names kept_text, n_lines, n_dropped, rk and drop are
    this operator's: such input columns are replaced. A null text counts as one empty line and stays null if nothing goes.
    Keys under min_chars characters never count. Rows with equal doc_id and text are decided alike, and each counts as a
    document. A null doc_id sorts first. An empty table gives an empty result.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    spark = docs.sparkSession
    docs = docs.drop("kept_text", "n_lines", "n_dropped", "rk", "drop")
    # min_chars counts characters; a key of that many characters has at least as many bytes, and only 0 and 1 mean the same
    if min_chars > 1:
        raise ValueError("min_chars is 0 or 1")
    packed = staged(docs.select("text").mapInArrow(_once_twice(min_chars), "slice int, many boolean, n long, hashes binary"), "line-hashes")
    n = packed.agg(F.sum("n")).first()[0] or 0
    bits = SLICES << max(10, int(np.ceil(np.log2(max(1, n * bits_per_key) / SLICES))))
    keyed = docs.withColumn("rk", row_key())
    if bits <= max_bits:
        filters = packed.repartition("slice").sortWithinPartitions("slice").mapInArrow(_fill(bits // SLICES), "slice int, twice binary").collect()
        seen = np.zeros((SLICES, bits // SLICES // 8), np.uint8)
        for s, twice in filters:
            seen[s] = np.frombuffer(twice, np.uint8)
        shared = spark.sparkContext.broadcast(seen)
        suspects = keyed.select("rk", "text").mapInArrow(_suspects(shared, bits // SLICES, min_chars), "rk binary, key binary, lines array<int>")
    else:
        suspects = _sliced_suspects(keyed, packed, bits, min_chars)
    if keep == "first":
        ids = docs.select(row_key().alias("rk"), F.col("doc_id").cast("string").alias("sid"), "doc_id").distinct()
        suspects = suspects.join(ids.select("rk", "doc_id"), "rk")
        suspects = staged(suspects, "line-suspects")
        first = F.min(F.struct("doc_id", "rk")).alias("first")
        keys = staged(suspects.groupBy("key").agg(F.count("*").alias("n"), first).filter(F.col("n") >= min_docs), "line-keys")
        hit = suspects.join(keys.select("key", F.col("first.rk").alias("first_rk")), "key").dropDuplicates(["rk", "key"])
        rest = F.expr("slice(lines, 2, greatest(size(lines) - 1, 0))")
        hit = hit.select("rk", F.when(F.col("rk") == F.col("first_rk"), rest).otherwise(F.col("lines")).alias("lines"))
    else:
        suspects = staged(suspects, "line-suspects")
        # staged, so that the join reads two plain exchanges, of which Spark can split a hot key's
        keys = staged(suspects.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs), "line-keys")
        hit = suspects.join(keys.select("key"), "key").dropDuplicates(["rk", "key"]).select("rk", "lines")
    # equal rows have one key here: what is gathered is the lines of one text
    drop = hit.groupBy("rk").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("drop"))
    columns = docs.columns
    out = keyed.join(drop, "rk", "left").select(*columns, "drop")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return out.mapInArrow(_rebuild(columns), f"{schema}, kept_text string, n_lines long, n_dropped long")
