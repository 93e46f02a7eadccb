"""Near-duplicate groups by bottom-k sketches from one hash function.

Texts with equal shingle sets are one class. A class's sketch is its SKETCH smallest shingle hashes.

Candidates come from inverted lists of retained values. Two sets as alike as asked for share most of their retained values, so it
is enough to list each class under those of its values that come first in one order of all values, as many as make sure
that both lists of such a pair meet (prefix filtering). The order puts rare values first: counts of all retained values of all classes
are summed in a table of fixed size, which is broadcast. Frequent words, lines and passages thus head no list.

A list of few classes gives its pairs. A long one gives each class's pairs with a few centers only: those members whose values stand
in the longest lists, which is what the source of many copies looks like. A pair of full sketches that meets in fewer than MEETINGS lists is
no candidate (prefixes are that much longer, so the bound below holds). The rest first compare bitmaps of their retained values, since two
sketches differ in as many values at least as their bitmaps differ in bits: what differs in more than the bound below allows goes before any
sketch moves. Then come an estimate from the union's sketch, and exact Jaccard on full sets, which confirms.

What long lists leave is finished exactly. In each long list, the members that are not yet with most of it compare their bitmaps with all of it.
Classes that these may connect are a family; texts that only share a frequent value are not. A group of near copies has many long lists of about
the same members, so each class first meets others in its longest list only; then all lists meet, and only what joins the families of the first
time is a link. A task gives each class once, with the smallest that it connects it to. So links are about as many as classes, not as entries of lists nor
as pairs of blocks. A family's members that are not yet with most of the
family are compared with all of it, block of sets by block of sets: a pair of blocks counts all its intersections at once, and a block
is copied once for every few others that it meets, so neither a family's pairs nor a family ever lies in one task, nor on disk.

The bounds: a true pair is missed only if its shared values among its sketches fall five standard deviations below what
is expected at the asked similarity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bitmap, discard, maybe_among, mix, ranked, row_key, shingles, slices, staged, words

SKETCH = 128
#: The counts of retained values are kept in so many cells, whatever the input.
CELLS, BLOCK = 1 << 20, 1 << 14
SIGMAS = 5.0
#: Lists longer than this, or than the fourth root of the number of classes, give pairs with centers only.
LONG = 32
#: Sets and bytes of a block, or one set if it is larger.
SETS, BLOCK_BYTES = 128, 2 << 20
#: Bits of a bitmap of retained values, and how many bitmaps a block has.
BITS, BITMAPS = 512, 512
#: So many blocks on either side meet in one place.
CELL = 8
#: A task remembers so many names of what it has connected; then it gives its links and starts anew.
JOINED = 1 << 17
#: Where both sets are cut to sketches, a pair must meet in so many lists; prefixes are longer by as many, less one, so that it does.
MEETINGS = 3


def _spread(k: int, similarity: float) -> float:
    return SIGMAS * math.sqrt(k * similarity * (1 - similarity))


def least_shared(n: np.ndarray, similarity: float, k: int = SKETCH) -> np.ndarray:
    """How many retained values a set of size n shares with any set that is as similar."""
    n = np.asarray(n)
    small = np.ceil(similarity * n - 1e-9)  # neither set can be cut if the larger one, n / similarity, is within k
    cut = max(1, math.floor(k * similarity - _spread(k, similarity)))
    return np.maximum(1, np.where(n <= similarity * k, small, np.minimum(cut, np.minimum(n, k)))).astype(np.int64)


def _is_cut(n: np.ndarray, similarity: float) -> np.ndarray:
    """Whether a set of this size and any that is as similar are both larger than a sketch."""
    return n * similarity > SKETCH


def _digest(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """16 bytes for each set: two independent sums over its elements, mixed."""
    a = np.add.reduceat(mix(h ^ np.uint64(0x2545F4914F6CDD1D)), first)
    b = np.add.reduceat(mix(h + np.uint64(0x9E6C63D0876A9A47)), first)
    both = np.stack([mix(a), mix(b)], axis=1).astype(">u8")
    return [x.tobytes() for x in both]


def _sketch(size: int):
    """For each row its set's size, digest and sketch; the sketch of a text without words is empty."""

    def run(batches):
        for batch in slices(batches, "text"):
            h, row = shingles(*words(batch.column("text")), size)
            n = np.bincount(row, minlength=batch.num_rows)
            first = np.r_[0, np.cumsum(n)[:-1]]
            full = np.flatnonzero(n)
            digest, sketch = [b""] * batch.num_rows, [b""] * batch.num_rows
            if len(full):
                for i, d in zip(full, _digest(h, first[full]), strict=True):
                    digest[i] = d
                    sketch[i] = h[first[i] : first[i] + min(n[i], SKETCH)].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), pa.array(n), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "rk", "n", "cls", "sketch"])

    return run


def _values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    packed = batch.column("sketch").to_pylist()
    return np.frombuffer(b"".join(packed), np.uint64), np.fromiter((len(x) // 8 for x in packed), np.int64, len(packed))


def _cell(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(44)).astype(np.int64)


def _counts(batches):
    cells = np.zeros(CELLS, np.uint32)
    for batch in batches:
        cells += np.bincount(_cell(_values(batch)[0]), minlength=CELLS).astype(np.uint32)
    blocks = cells.reshape(-1, BLOCK)
    full = np.flatnonzero(blocks.any(axis=1))
    if len(full):
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([blocks[i].tobytes() for i in full], pa.binary())], names=["block", "cells"])


def _summed(batches):
    at, total = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "cells"])
    for batch in batches:
        for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            own = np.frombuffer(cells, np.uint32)
            if block != at:
                if at is not None:
                    yield done()
                at, total = block, own.astype(np.uint32)
            else:
                total = np.minimum(total.astype(np.uint64) + own, 0xFFFFFFFF).astype(np.uint32)
    if at is not None:
        yield done()


def _lists(counts, similarity: float):
    """The values under which each class is listed: the rarest of its sketch."""

    def run(batches):
        table = counts.value
        for batch in batches:
            h, m = _values(batch)
            n = batch.column("n").to_numpy()
            prefix = np.maximum(0, m - least_shared(n, similarity) + np.where(_is_cut(n, similarity), MEETINGS, 1))
            row = np.repeat(np.arange(len(m)), m)
            order = np.lexsort((h, table[_cell(h)], row))
            place = np.arange(len(h)) - np.repeat(np.r_[0, np.cumsum(m)[:-1]], m)
            take = order[place < prefix[row]]
            row = row[take]
            yield pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), batch.column("cls").take(pa.array(row)), pa.array(n[row])], names=["value", "cls", "n"])

    return run


def _bitmaps(batches):
    """For each class the bitmap of its retained values."""
    for batch in batches:
        if batch.num_rows:
            h, m = _values(batch)
            bits = np.zeros((batch.num_rows, BITS), bool)
            bits[np.repeat(np.arange(len(m)), m), (mix(h ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(BITS)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["cls", "n", "bits"])


def _may_differ(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """In how many retained values two sets of these sizes may differ if they are alike, within the bound; below 0 if sizes rule it out."""
    least = np.maximum(least_shared(na, percent / 100), least_shared(nb, percent / 100))
    whole = np.maximum(na, nb) <= SKETCH
    least = np.where(whole, -(-percent * (na + nb) // (100 + percent)), least)
    most = np.minimum(na, SKETCH) + np.minimum(nb, SKETCH) - 2 * least
    return np.where(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb), most, -1)


def _packed(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), BITS // 64)


def _few_differ(percent: int):
    """Keeps pairs whose bitmaps do not rule them out."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = _packed(batch.column("bits_a").to_pylist()), _packed(batch.column("bits_b").to_pylist())
                most = _may_differ(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= most))

    return run


def _forest(met: np.ndarray) -> list[tuple[int, int]]:
    """As many places of a matrix as connect all rows and columns that its true places connect."""
    out, rows, columns = [], met.any(axis=1), met.any(axis=0)
    for i in np.flatnonzero(rows):
        if not rows[i]:
            continue
        rows[i], todo = False, [i]
        while todo:
            r = todo.pop()
            new = np.flatnonzero(met[r] & columns)
            columns[new] = False
            for c in new:
                out.append((r, c))
                more = np.flatnonzero(met[:, c] & rows)
                rows[more] = False
                out += [(x, c) for x in more]
                todo += more.tolist()
    return out


class _Joined:
    """What a task has connected."""

    def __init__(self):
        self.up = {}

    def _find(self, x):
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a, b) -> None:
        a, b = self._find(a), self._find(b)
        self.up[max(a, b)] = min(a, b)

    def full(self) -> bool:
        return len(self.up) > JOINED

    def links(self) -> pa.RecordBatch:
        """Each name with the smallest that it is connected to; then it starts anew."""
        found = [(x, y) for x in list(self.up) if (y := self._find(x)) != x]
        self.up.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])


def _alike_blocks(percent: int):
    """Links of known families whose classes' bitmaps do not rule them out: over all blocks of a task, each with the smallest that it is
    connected to. Classes of one label or one family are not compared."""

    def run(batches):
        joined = _Joined()
        for batch in batches:
            for a, b in zip(batch.column("mine").to_pylist(), batch.column("theirs").to_pylist(), strict=True):
                one, two = _packed([x["bits"] for x in a]), _packed([x["bits"] for x in b])
                labels, known = {}, {}
                la, lb = (np.array([labels.setdefault(x["label"], len(labels)) for x in rows]) for rows in (a, b))
                ka, kb = (np.array([known.setdefault(x["known"], len(known)) for x in rows]) for rows in (a, b))
                na, nb = (np.array([x["n"] for x in rows]) for rows in (a, b))
                differ = np.zeros((len(one), len(two)), np.int32)
                for k in range(BITS // 64):
                    differ += np.bitwise_count(one[:, k, None] ^ two[None, :, k])
                apart = (la[:, None] != lb[None, :]) & (ka[:, None] != kb[None, :])
                for i, j in _forest((differ <= _may_differ(na[:, None], nb[None, :], percent)) & apart):
                    joined.join(a[i]["known"], b[j]["known"])
                if joined.full():
                    yield joined.links()
        yield joined.links()

    return run


def _estimate(similarity: float):
    """Keeps pairs that the sketch of their union does not rule out."""

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), strict=True)):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.union1d(a, b)[:SKETCH]
                shared = len(np.intersect1d(a, b, assume_unique=True)) if len(both) < SKETCH else int((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).sum())
                least = similarity * len(both) - (_spread(len(both), similarity) if len(both) == SKETCH else 1e-6)
                if shared >= least:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _sets(size: int):
    def run(batches):
        for batch in slices(batches, "text"):
            h, row = shingles(*words(batch.column("text")), size)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([h[at[i] : at[i + 1]].tobytes() for i in range(batch.num_rows)], pa.binary())], names=["cls", "set"])

    return run


def _exact(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _block_pairs(percent: int):
    """Links of labels between blocks of sets: over all blocks of a task, each label with the smallest that it is connected to."""

    def run(batches):
        joined = _Joined()
        for batch in batches:
            for a, b in zip(batch.column("mine").to_pylist(), batch.column("theirs").to_pylist(), strict=True):
                one, two = [np.frombuffer(x["set"], np.uint64) for x in a], [np.frombuffer(x["set"], np.uint64) for x in b]
                na, nb = np.array([len(x) for x in one]), np.array([len(x) for x in two])
                both = np.intersect1d(np.unique(np.concatenate(one)), np.unique(np.concatenate(two)), assume_unique=True)
                shared = np.zeros((len(one), len(two)), np.float32)
                for k in range(0, len(both), 4096):
                    part = both[k : k + 4096]

                    def grid(sets, part=part):
                        out = np.zeros((len(sets), len(part)), np.float32)
                        for i, x in enumerate(sets):
                            at = np.minimum(np.searchsorted(part, x), len(part) - 1)
                            out[i, at[part[at] == x]] = 1
                        return out

                    shared += grid(one) @ grid(two).T
                linked = 100 * shared >= percent * (na[:, None] + nb[None, :] - shared)
                for i, j in zip(*np.nonzero(linked), strict=True):
                    joined.join(a[i]["label"], b[j]["label"])
                if joined.full():
                    yield joined.links()
        yield joined.links()

    return run


def _meetings(each: DataFrame, group: str, data: DataFrame, compare, percent: int, fit: int, step_bytes: int | None = None) -> DataFrame:
    """What compare yields of blocks of each(group, cls, n, label) that meet: members that are not yet with most of their group meet all of it.
    data(cls, one more column) has a row for each class; it is joined once, when every member has its block. Further columns of each go with its rows.

    Blocks are of fit rows. With step_bytes, or in a group of more rows, they are of sets of about one size, so that unequal blocks need not meet
    and, with step_bytes, a block's bytes are bounded. A block is copied for each cell of CELL blocks that it meets, not for each block."""
    more = [c for c in each.columns if c not in (group, "cls", "n", "label")]
    size = each.groupBy(group, "label").agg(F.count("*").alias("k"))
    most = size.groupBy(group).agg(F.max(F.struct("k", "label")).alias("m"), F.sum("k").alias("all")).select(group, F.col("m.label").alias("most"), "all")
    most = staged(most, "most")
    each = each.join(most, group).withColumn("outer", F.col("label") != F.col("most"))
    step = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent)).cast("int")
    rows = F.lit(fit).cast("long")
    if step_bytes:
        rows = F.least(rows, F.greatest(F.lit(1), F.floor(step_bytes / 8 / F.pow(F.lit(100 / percent), step + 1)))).cast("long")
    else:
        step = F.when(F.col("all") > fit, step).otherwise(0)
    each = each.withColumn("tier", F.when(F.col("outer"), 0).otherwise(100_000) + step).withColumn("fit", rows)
    each = staged(each.select(group, "cls", "n", "label", *more, "outer", "tier", "fit"), "tiers")
    # each is small in Parquet and large in memory: it is not to be broadcast
    placed = ranked(each, [group, "tier"], ["cls"], "place").withColumn("at", F.expr("place div fit")).hint("merge").join(data, "cls")
    placed = placed.withColumn("block", F.col("tier") * F.lit(1 << 40) + F.col("at")).withColumn("cell", F.col("tier") * F.lit(1 << 40) + F.expr(f"at div {CELL}"))
    blocks = placed.groupBy(group, "cell", "block").agg(F.collect_list(F.struct("cls", "label", "n", *more, data.columns[-1])).alias("rows"), F.max("outer").alias("outer"), F.min("n").alias("low"), F.max("n").alias("high"))
    blocks = staged(blocks, "blocks")
    sizes = (F.col("ha") * 100 >= F.col("lb") * percent) & (F.col("hb") * 100 >= F.col("la") * percent)
    cells = blocks.groupBy(group, "cell").agg(F.max("outer").alias("outer"), F.min("low").alias("low"), F.max("high").alias("high"))
    one = cells.filter("outer").select(group, F.col("cell").alias("cx"), F.col("low").alias("la"), F.col("high").alias("ha"))
    two = cells.select(group, F.col("cell").alias("cy"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.col("outer").alias("too"))
    met = staged(one.join(two, group).filter((~F.col("too") | (F.col("cx") <= F.col("cy"))) & sizes).select(group, "cx", "cy"), "cells")
    a = blocks.filter("outer").select(group, F.col("cell").alias("cx"), F.col("block").alias("x"), F.col("rows").alias("mine"), F.col("low").alias("la"), F.col("high").alias("ha"))
    b = blocks.select(group, F.col("cell").alias("cy"), F.col("block").alias("y"), F.col("rows").alias("theirs"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.col("outer").alias("too"))
    pairs = a.join(met, [group, "cx"]).join(b.join(met, [group, "cy"]), [group, "cx", "cy"]).filter((~F.col("too") | (F.col("x") <= F.col("y"))) & sizes)
    out = staged(pairs.select("mine", "theirs").mapInArrow(compare, "a binary, b binary"), f"{group}-links")
    discard(most, each, blocks, met)
    return out


def _family_links(long: DataFrame, bits: DataFrame, labels: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links between components that long lists leave apart. sets_of gives the full sets of classes, and is asked for those in families only."""
    labels = labels.withColumnRenamed("node", "cls")
    named = staged(long.join(labels, "cls", "left").select("value", "cls", "n", F.coalesce("label", "cls").alias("label")), "named")
    split = named.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("many"))
    split = staged(split.filter("low <> high").select("value", "many"), "split")
    left = named.join(split, "value").groupBy("cls").agg(F.min("n").alias("n"), F.min("label").alias("label"), F.max(F.struct("many", "value")).alias("longest"), F.collect_list("value").alias("lists"))
    left = staged(left.select("cls", "n", "label", F.col("longest.value").alias("longest"), "lists"), "left")  # SKETCH lists at most
    bits = bits.select("cls", "bits")
    once = left.select(F.col("longest").alias("value"), "cls", "n", "label", F.col("cls").alias("known"))
    first = _meetings(once, "value", bits, _alike_blocks(percent), percent, BITMAPS)
    known = first.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("known"))  # what tasks connect further, the second time finds again
    entries = left.join(known, "cls", "left").select(F.explode("lists").alias("value"), "cls", "n", "label", F.coalesce("known", "cls").alias("known"))
    near = _meetings(entries, "value", bits, _alike_blocks(percent), percent, BITMAPS)
    family = components(first.unionByName(near)).select(F.col("node").alias("cls"), F.col("label").alias("family"))
    each = staged(left.select("cls", "n", "label").join(family, "cls"), "families")
    sets = sets_of(each)
    links = _meetings(each, "family", sets, _block_pairs(percent), percent, SETS, BLOCK_BYTES)
    discard(named, split, left, first, near, each, sets)
    return links


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, keys: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text), and with keys its row key, rk.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text with fewer words than shingle has one shingle of all. Rows
    whose sets have 100 * intersection >= percent * union are linked; component_id is the smallest doc_id that links reach.
    A null or wordless text is linked with nothing. A null doc_id is never a component_id of others: such a row is not kept where
    others with ids are in its group, and has a null component_id (and is kept) where none is. Rows of one doc_id are one
    document for kept: all or none are. Other columns are not read. Empty in, empty out.
    """
    similarity = percent / 100
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", "text").withColumn("rk", row_key())
    drawn = staged(keyed.mapInArrow(_sketch(shingle), f"doc_id {kind}, rk binary, n long, cls binary, sketch binary"), "sketches")
    classes = staged(drawn.filter("n > 0").groupBy("cls").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("rk").alias("rk")), "classes")
    members = staged(drawn.select("doc_id", "rk", "n", "cls"), "members")
    discard(drawn)
    cells = classes.select("sketch").mapInArrow(_counts, "block int, cells binary").repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "block int, cells binary")
    counts = np.zeros((CELLS // BLOCK, BLOCK), np.uint32)
    for r in cells.collect():  # CELLS counts, whatever the input
        counts[r["block"]] = np.frombuffer(r["cells"], np.uint32)
    counts = spark.sparkContext.broadcast(counts.reshape(-1))
    listed = classes.select("cls", "n", "sketch").mapInArrow(_lists(counts, similarity), "value long, cls binary, n long")
    many = staged(listed.groupBy("value").agg(F.count("*").alias("many")).filter("many > 1"), "many")
    lists = staged(listed.join(many, "value"), "lists")
    discard(many)

    def alike(a: str, b: str):
        """Sizes rule out what is too unequal."""
        return F.least(a, b) * 100 >= F.greatest(a, b) * percent

    most = max(LONG, math.ceil(classes.count() ** 0.25))
    short = lists.filter(F.col("many") <= most)
    one, two = short.select("value", F.col("cls").alias("a"), F.col("n").alias("na")), short.select("value", F.col("cls").alias("b"), F.col("n").alias("nb"))
    pairs = one.join(two, "value").filter((F.col("a") < F.col("b")) & alike("na", "nb")).select("a", "b", F.least("na", "nb").alias("n"))
    long = lists.filter(F.col("many") > most)
    long = long.groupBy("cls").agg(F.min("n").alias("n"), F.sum(F.log("many")).alias("fame"), F.collect_list("value").alias("values"))  # SKETCH values at most
    long = staged(long.select("cls", "n", "fame", F.explode("values").alias("value")), "long")
    center = F.struct("fame", "cls", "n")
    half = lambda k: F.max(F.when(F.pmod(F.xxhash64("cls"), F.lit(2)) == k, center))
    heads = staged(long.groupBy("value").agg(F.max(center).alias("c0"), half(0).alias("c1"), half(1).alias("c2")), "heads")
    stars = long.join(heads, "value").select("cls", "n", F.explode(F.array_distinct(F.array("c0", "c1", "c2"))).alias("c"))
    stars = stars.filter(F.col("c.cls").isNotNull() & (F.col("c.cls") != F.col("cls")) & alike("n", "c.n"))
    stars = stars.select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b"), F.least("n", "c.n").alias("n"))

    shared = F.when(F.col("n") * similarity > SKETCH, MEETINGS).otherwise(1)
    pairs = pairs.unionByName(stars).groupBy("a", "b").agg(F.count("*").alias("met"), F.min("n").alias("n")).filter(F.col("met") >= shared)
    met = staged(pairs.select("a", "b"), "met")
    discard(lists)
    both = lambda df: df.select(F.col("a").alias("cls")).union(df.select(F.col("b").alias("cls"))).distinct()
    known = staged(both(met).union(long.select("cls")).distinct(), "meeting")
    # a filter first: only classes that meet any other move, and their sketches only if bitmaps do not rule it out
    bits = staged(maybe_among(classes.select("cls", "n", "sketch"), "cls", bitmap(known, "cls")).mapInArrow(_bitmaps, "cls binary, n long, bits binary"), "meeting-bits")
    own, other = bits.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")), bits.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    near = staged(met.join(own, "a").join(other, "b").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_few_differ(percent), "a binary, b binary"), "near")
    discard(met, known)
    known = staged(both(near), "near-classes")
    drawn = staged(maybe_among(classes.select("cls", "sketch"), "cls", bitmap(known, "cls")), "meeting-sketches")
    own, other = drawn.select(F.col("cls").alias("a"), F.col("sketch").alias("sketch_a")), drawn.select(F.col("cls").alias("b"), F.col("sketch").alias("sketch_b"))
    pairs = staged(near.join(own, "a").join(other, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(_estimate(similarity), "a binary, b binary"), "candidates")
    discard(drawn, near, known)

    needed = both(pairs).union(long.select("cls")).distinct()
    reps = staged(classes.select("cls", "rk").join(needed, "cls"), "needed")
    discard(classes)

    def sets_of(own: DataFrame) -> DataFrame:
        """The full sets of these classes, which reps has."""
        asked = staged(reps.join(own.select("cls").distinct(), "cls"), "asked")
        texts = maybe_among(keyed.select("rk", "text"), "rk", bitmap(asked, "rk")).join(asked, "rk").select("cls", "text")
        sets = staged(texts.mapInArrow(_sets(shingle), "cls binary, set binary").groupBy("cls").agg(F.min("set").alias("set")), "sets")  # equal rows have one rk
        discard(asked)
        return sets

    sets = sets_of(both(pairs))
    own = sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a"))
    other = sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b"))
    links = staged(pairs.join(own, "a").join(other, "b").select("a", "b", "set_a", "set_b").mapInArrow(_exact(percent), "a binary, b binary"), "links")
    discard(pairs, sets)  # of long lists, only families need sets
    labels = components(links)
    more = _family_links(long, bits, labels, sets_of, percent)
    discard(reps, long, heads, bits)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    discard(more, links)

    grouped = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    grouped = staged(grouped.select("doc_id", "rk", "n", "label"), "grouped")
    discard(members)
    lowest = staged(grouped.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("low")), "lowest")
    out = grouped.join(lowest, "label", "left")
    component = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id"))
    return out.select(*(["rk"] if keys else []), "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
