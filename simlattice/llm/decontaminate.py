"""Benchmark decontamination by embedding edit distance into Hamming distance.

Texts and items are words: lower-cased, signs at their ends cut off. An item stands in a document if some stretch of the document's
words is within TOLERANCE of the item's words by edit distance.

The random-walk embedding (Chakraborty, Goldenberg, Koucky) copies a string while a pointer moves on or stays by a random bit of
the word under it and the step; strings a few edits apart stay in step again and again, so few places of their copies differ. Each
item gives windows of about its own size (four fifths or more of its words, up to LONG). Windows of the same size over a document
are embedded in the same way, sampled at a few places, and looked up; samples repeat until items of each length, edited at the
tolerance, are found at the target recall. Items of a length that never gets there are cut into one part more than edits are
allowed, of which one always stands whole. A window can only be
that near an item's if most of its words are words of items at all, so others are not embedded. What is found is verified by
exact edit distance. Documents are never shuffled: items go to them, in blocks of a bounded number.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SPACE, flat, hashes, mix, slices, spans

TOLERANCE = 0.2
RECALL = 0.99
#: Window sizes in words grow by a quarter or less; an item uses the largest that it can fill. The largest are of about LONG words: longer
#: items give several windows.
LONG = 64
SIZES = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 18, 22, 27, 33, 41, 51, 63)
EMBEDDINGS = 5


def _steps(size: int) -> int:
    """Steps of a walk over a window: in so many it passes three quarters of the words, about."""
    return max(2, 3 * size // 2)


MOST_REPEATS = 100
#: Edited items drawn for each length; of items over LONG words, the first LONG.
TRIALS = 800
BLOCK = 20_000
#: Equal keys that are looked at together.
TOGETHER = 200_000


def _places(size: int, windows: int) -> int:
    """How many places of a window's copy a sample reads: fewer of long copies, which edits part more often, more among many windows."""
    return min(size, (4 if size <= 12 else 3 if size <= 33 else 2) + max(0, int(np.log10(max(1, windows / 1000)))))


_INNER = np.zeros(256, bool)
_INNER[48:58] = _INNER[65:91] = _INNER[97:123] = _INNER[128:] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, and their rows. A word of signs only is none."""
    data, starts = flat(column)
    data = LOWER[data]
    begin, end, row = spans(data, starts, ~SPACE[data])
    if not len(begin):
        return np.zeros(0, np.uint64), row
    inner = _INNER[data]
    after = np.minimum.accumulate(np.where(inner, np.arange(len(data)), len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(inner, np.arange(len(data)), -1))
    begin, end = after[begin], before[end - 1] + 1
    real = begin < end
    return hashes(data, begin[real], end[real]) | np.uint64(1), row[real]


def embed(words: np.ndarray, begin: np.ndarray, end: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """The walk's copy of each window words[begin:end], of so many steps; beyond the window it copies zeros."""
    at = begin.copy()
    out = np.zeros((len(begin), steps), np.uint64)
    last = max(0, len(words) - 1)
    for j in range(steps):
        inside = at < end
        under = np.where(inside, words[np.minimum(at, last)], 0)
        out[:, j] = under
        at = at + (mix(under + np.uint64((seed * 1_000_003 + j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(np.int64)
    return out


_FACTORS = mix(np.arange(1, 4 * LONG, dtype=np.uint64)) | np.uint64(1)


def _sampled(copy: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A key of the words at these places."""
    key = np.zeros(len(copy), np.uint64)
    for k, p in enumerate(places):
        key += copy[:, p] * _FACTORS[k % len(_FACTORS)] + (key >> np.uint64(29))
    return mix(key)


def _leading(sorted_: np.ndarray) -> np.ndarray:
    """Which leading 16 bits of a hash some of these has."""
    out = np.zeros(1 << 16, bool)
    out[(sorted_ >> np.uint64(48)).astype(np.int64)] = True
    return out


def _met(mine: np.ndarray, keys: np.ndarray, leading: np.ndarray):
    """Pairs (place in mine, place in keys) of equal keys, in slices of about TOGETHER pairs; keys are sorted."""
    own = np.flatnonzero(leading[(mine >> np.uint64(48)).astype(np.int64)])
    lo, hi = np.searchsorted(keys, mine[own], "left"), np.searchsorted(keys, mine[own], "right")
    own, lo, many = own[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    ends = np.cumsum(many)
    at = 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")))
        some = many[at:to]
        yield np.repeat(own[at:to], some), np.repeat(lo[at:to] - np.cumsum(some) + some, some) + np.arange(some.sum())
        at = to


@dataclass
class Probes:
    """Items by number, and for each window size the sampled keys of their windows."""

    ids: list
    items: list[np.ndarray]
    tolerance: float
    #: words of items, each mixed with its item's number
    owned: np.ndarray
    #: size -> sorted words of its items, which leading 20 bits of a hash some of them has, the rarer words, and how many of them a window needs
    vocabulary: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]]
    #: size -> list of (embedding seed, places, sorted keys, their leading bits, item numbers, offsets)
    tables: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
    #: length -> sorted keys of parts, their leading bits, item numbers, offsets, sorted words; of items that samples do not find at the target
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _owned(words: np.ndarray, item: np.ndarray | int) -> np.ndarray:
    return mix(words ^ mix(np.atleast_1d(np.asarray(item)).astype(np.uint64) + np.uint64(1)))


def _least_known(size: int, tolerance: float) -> int:
    """How many words of a window must be words of items: all but its share of edits."""
    return max(1, size - int(np.ceil(tolerance * size)))


def _rarer(words: np.ndarray, begin: np.ndarray, size: int, tolerance: float, common: dict[int, int]) -> tuple[np.ndarray, int]:
    """The rarer half of what every item window must keep of its distinct words, with as many more as edits may take: a document's
    window that is that near an item's has so many of them, at least."""
    lost, rare, least = int(np.ceil(tolerance * size)), set(), size
    for at in begin.tolist():
        own = sorted(set(words[at : at + size].tolist()), key=lambda x: (common[x], x))
        kept = max(0, -(-(len(own) - lost) // 2))
        rare.update(own[: lost + kept])
        least = min(least, kept)
    return np.array(sorted(rare), np.uint64), least


def _edited(words: np.ndarray, edits: int, rng: np.random.Generator, only: int | None = None) -> np.ndarray:
    """words with random edits: 0 takes a word out, 1 puts one in, 2 changes one; of all kinds if none is given."""
    out = words.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(len(out))), int(rng.integers(3))
        kind = kind if only is None else only
        if kind == 0 and len(out) > 1:
            del out[at]
        elif kind == 1:
            out.insert(at, int(rng.integers(1 << 62)) * 2 + 1)
        else:
            out[at] = int(rng.integers(1 << 62)) * 2 + 1
    return np.array(out, np.uint64)


def _classes(items: list[np.ndarray], own: list[int]) -> list[list[int]]:
    """The items by length, from LONG words on together."""
    out: dict[int, list[int]] = {}
    for i in own:
        out.setdefault(min(len(items[i]), LONG), []).append(i)
    return [out[n] for n in sorted(out)]


def _repeats(items: list[np.ndarray], group: list[int], size: int, tolerance: float, recall: float, known: np.ndarray, rare: np.ndarray, needed: int, chosen: list[np.ndarray], keys: list[np.ndarray], which: np.ndarray, seed: int, rng: np.random.Generator) -> int | None:
    """How many samples find the target share of the group's shortest items, with as many edits as the tolerance allows, of each kind
    and of all kinds; None if none do."""
    least = min(len(items[i]) for i in group)
    shortest = [i for i in group if len(items[i]) == least]
    parts, trial, owner = [], [], []
    for k in range(TRIALS):
        i = shortest[int(rng.integers(len(shortest)))]
        around = rng.integers(1 << 62, size=(2, size)).astype(np.uint64) << np.uint64(1)  # words of no item: theirs are odd
        parts.append(np.concatenate([around[0], _edited(items[i][:LONG], int(tolerance * min(least, LONG)), rng, k % 4 if k % 4 < 3 else None), around[1]]))
        trial.append(np.full(len(parts[-1]), k))
        owner.append(i)
    words, trial, owner = np.concatenate(parts), np.concatenate(trial), np.array(owner)
    ends = np.searchsorted(trial, trial, side="right")
    starts = np.arange(len(words))
    total = np.r_[0, np.cumsum(_member(words, known))]
    rarer = np.r_[0, np.cumsum(_member(words, rare))]
    past = np.minimum(starts + size, ends)
    starts = starts[(total[past] - total[starts] >= _least_known(size, tolerance)) & (rarer[past] - rarer[starts] >= needed)]
    copies = [embed(words, starts, np.minimum(starts + size, ends[starts]), _steps(size), seed + e) for e in range(EMBEDDINGS)]
    trial = trial[starts]
    hit = np.zeros(TRIALS, bool)
    own = np.flatnonzero(np.isin(which, shortest))
    for r, places in enumerate(chosen):
        there = np.unique(_owned(keys[r][own], which[own]))
        open_ = np.flatnonzero(~hit[trial])
        shown = _owned(_sampled(copies[r % EMBEDDINGS][open_], places), owner[trial[open_]])
        hit[trial[open_[_member(shown, there)]]] = True
        # each kind of edit for itself; with half of what may be missed, and a third more samples, since trials are few
        if r + 1 >= EMBEDDINGS and min(hit[k::4].mean() for k in range(4)) >= (1 + recall) / 2:
            return min(len(chosen), r + 1 + (r + 1) // 3)
    return None


def _parts(items: list[np.ndarray], own: list[int], tolerance: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Length -> sorted keys of parts of so many words, their leading bits, item numbers and offsets, and the sorted words of all.

    Each item is cut into one part more than it may have edits, so one of them stands whole wherever the item stands."""
    found: dict[int, list[tuple[int, int]]] = {}
    for i in own:
        n = len(items[i])
        cuts = np.linspace(0, n, min(int(tolerance * n) + 1, n) + 1).astype(int).tolist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            found.setdefault(hi - lo, []).append((i, lo))
    out = {}
    for length, places in found.items():
        runs = np.concatenate([items[i][lo : lo + length] for i, lo in places]).reshape(-1, length)
        keys = _run_keys(runs)
        order = np.argsort(keys, kind="stable")
        out[length] = keys[order], _leading(keys), np.array([i for i, _ in places])[order], np.array([lo for _, lo in places])[order], np.unique(runs)
    return out


def _run_keys(runs: np.ndarray) -> np.ndarray:
    return _sampled(runs, np.arange(runs.shape[1]))


def prepare(ids: list, items: list[np.ndarray], tolerance: float = TOLERANCE, recall: float = RECALL, seed: int = 11) -> Probes:
    """Embeds the items' windows and repeats samples until edited items of every length are found at the target recall.

    Where MOST_REPEATS are not enough, the items of that length are also looked up exactly, by their parts."""
    vocabulary = {}
    owned = np.unique(np.concatenate([np.zeros(0, np.uint64), *[_owned(words, i) for i, words in enumerate(items)]]))
    common = Counter(x for words in items for x in set(words.tolist()))
    by_size: dict[int, list[int]] = {}
    for i, words in enumerate(items):
        by_size.setdefault(max(s for s in SIZES if s <= len(words)), []).append(i)
    tables, exact = {}, []
    for size, own in by_size.items():
        rng = np.random.default_rng(seed + size)
        known = np.unique(np.concatenate([items[i] for i in own]))
        leading = np.zeros(1 << 20, bool)
        leading[(known >> np.uint64(44)).astype(np.int64)] = True
        begin, which, offset, joined, at = [], [], [], [], 0
        for i in own:
            n = len(items[i])
            offsets = sorted({*range(0, n - size + 1, max(1, size // 4)), n - size})
            begin += [at + o for o in offsets]
            which += [i] * len(offsets)
            offset += offsets
            joined.append(items[i])
            at += n
        words, begin, which, offset = np.concatenate(joined), np.array(begin), np.array(which), np.array(offset)
        rare, needed = _rarer(words, begin, size, tolerance, common)
        vocabulary[size] = known, leading, rare, needed
        copies = [embed(words, begin, begin + size, _steps(size), seed + e) for e in range(EMBEDDINGS)]
        chosen = [np.sort(rng.choice(_steps(size), _places(size, len(begin)), replace=False)) for _ in range(MOST_REPEATS)]
        keys = [_sampled(copies[r % EMBEDDINGS], places) for r, places in enumerate(chosen)]
        # every class of lengths repeats until its own shortest items are found
        repeats, short = np.zeros(len(items), np.int64), []
        for group in _classes(items, own):
            enough = _repeats(items, group, size, tolerance, recall, known, rare, needed, chosen, keys, which, seed, rng)
            repeats[group] = enough or 0
            if enough is None:
                short += group
        # what is looked up exactly has no use for more samples than others need
        repeats[short] = max(EMBEDDINGS, int(repeats[own].max()))
        exact += short
        made = []
        for r in range(int(repeats[own].max())):
            mine = np.flatnonzero(repeats[which] > r)
            mine = mine[np.argsort(keys[r][mine], kind="stable")]
            made.append((seed + r % EMBEDDINGS, chosen[r], keys[r][mine], _leading(keys[r][mine]), which[mine], offset[mine]))
        tables[size] = made
    return Probes(list(ids), items, tolerance, owned, vocabulary, tables, _parts(items, exact, tolerance))


def distance(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """The least edit distance from item to a stretch of words, and where such a stretch ends."""
    n = len(words)
    steps = np.arange(n + 1)
    old = np.zeros(n + 1, np.int64)
    for x in item:
        new = old + 1
        new[1:] = np.minimum(new[1:], old[:-1] + (words != x))
        old = np.minimum.accumulate(new - steps) + steps
    return int(old.min()), int(old.argmin())


def _member(words: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(sorted_, words), len(sorted_) - 1)
    return sorted_[at] == words


def matches(words: np.ndarray, row: np.ndarray, probes: Probes, together: int = 300_000) -> list[tuple[int, int, int, int]]:
    """(row, item number, place of the stretch's end in its row, distance) for every item that stands in a row."""
    if not len(words):
        return []
    lead = (words >> np.uint64(44)).astype(np.int64)
    first = np.searchsorted(row, np.arange(row[-1] + 2))
    end_of = first[row + 1]
    found: set[tuple[int, int, int]] = set()
    for size, tables in probes.tables.items():
        vocabulary, leading, rare, needed = probes.vocabulary[size]
        known = leading[lead]
        maybe = np.flatnonzero(known)
        known[maybe] = _member(words[maybe], vocabulary)
        total = np.r_[0, np.cumsum(known)]
        maybe = np.flatnonzero(known)
        rarer = np.zeros(len(words) + 1, np.int64)
        rarer[maybe + 1] = _member(words[maybe], rare)
        rarer = np.cumsum(rarer)
        begin = np.arange(len(words))
        end = np.minimum(begin + size, end_of)
        # an item at the tolerance has a window with no more than its share of edits, and so with that many words of the item
        need = _least_known(size, probes.tolerance)
        begin = np.flatnonzero((total[end] - total[begin] >= need) & (rarer[end] - rarer[begin] >= needed))
        for k in range(0, len(begin), chunk := max(1, together // size)):  # so many words of windows, and their copies, at once
            own = begin[k : k + chunk]
            copies: dict[int, np.ndarray] = {}
            for seed, places, keys, leads, which, offset in tables:
                if seed not in copies:
                    copies[seed] = embed(words, own, end[own], _steps(size), seed)
                for hit, entry in _met(_sampled(copies[seed], places), keys, leads):
                    # enough of the window's words must be words of this item
                    start = own[hit]
                    at = start[:, None] + np.arange(size)[None, :]
                    inside = at < end_of[start][:, None]
                    mixed = _owned(words[np.minimum(at, len(words) - 1)], which[entry][:, None])
                    near = (_member(mixed.ravel(), probes.owned).reshape(mixed.shape) & inside).sum(axis=1) >= need
                    found.update(zip(*(x[near].tolist() for x in (row[start], which[entry], start - offset[entry])), strict=True))
    lengths = np.array([len(x) for x in probes.items])
    edits = (probes.tolerance * lengths).astype(int)
    for length, (keys, leads, which, offset, vocabulary) in probes.parts.items():
        total = np.r_[0, np.cumsum(_member(words, vocabulary))]
        begin = np.flatnonzero(np.arange(len(words)) + length <= end_of)
        begin = begin[total[begin + length] - total[begin] == length]
        for k in range(0, len(begin), chunk := max(1, together // length)):
            some = begin[k : k + chunk]
            for hit, entry in _met(_run_keys(words[some[:, None] + np.arange(length)]), keys, leads):
                own, item = some[hit], which[entry]
                start = own - offset[entry]
                from_, to = np.maximum(start - edits[item], first[row[own]]), np.minimum(start + lengths[item] + edits[item], end_of[own])
                width = int((to - from_).max(initial=1))
                for c in range(0, len(own), step := max(1, 500_000 // width)):
                    here = slice(c, c + step)
                    # enough of the words around must be words of this item
                    at = from_[here][:, None] + np.arange(width)[None, :]
                    mixed = _owned(words[np.minimum(at, len(words) - 1)], item[here][:, None])
                    shared = (_member(mixed.ravel(), probes.owned).reshape(mixed.shape) & (at < to[here][:, None])).sum(axis=1)
                    near = shared >= (lengths - edits)[item[here]]
                    found.update(zip(*(x[here][near].tolist() for x in (row[own], item, start)), strict=True))
    out, done, last = [], set(), None
    for r, i, start in sorted(found):
        item = probes.items[i]
        allowed = int(probes.tolerance * len(item))
        if (r, i) in done or last is not None and last[:2] == (r, i) and start - last[2] <= allowed // 2:
            continue
        last = (r, i, start)
        lo, hi = max(first[r], start - 2 * allowed - 1), min(first[r + 1], start + len(item) + 2 * allowed + 1)
        region = words[lo:hi]
        distinct = np.unique(item)
        if _member(region, distinct).sum() < len(item) - allowed or np.isin(distinct, region).sum() < len(distinct) - allowed:
            continue
        d, at = distance(item, region)
        if d <= allowed:
            done.add((r, i))
            out.append((r, i, int(lo + at - first[r]), d))
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Adds hits, array<struct<item_id, end, distance>> by item_id, to docs(doc_id, text, ...): the items of benchmark(item_id, text)
    that stand in each whole text, the place in words where a nearest stretch ends, and its edit distance.

    Items of null id or without words stand nowhere; items of one id and different texts each count. A null text has no hits. A
    column named hits is replaced, others pass through. Rows are independent. Each block of items is one more narrow step.
    """
    spark = docs.sparkSession
    docs = docs.drop("hits")
    columns = docs.columns
    kind = dict(benchmark.dtypes)["item_id"]
    rows = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    blocks = max(1, -(-rows.count() // block))
    hit = f"array<struct<item_id:{kind},end:long,distance:long>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", hits {hit}"
    out = docs.withColumn("hits", F.array().cast(hit))
    for b in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        words, row = tokens(pa.array([r["text"] for r in own], pa.string()))
        at = np.searchsorted(row, np.arange(len(own) + 1))
        items = [words[at[i] : at[i + 1]] for i in range(len(own))]
        full = [i for i in range(len(own)) if len(items[i])]
        probes = spark.sparkContext.broadcast(prepare([own[i]["item_id"] for i in full], [items[i] for i in full], tolerance, recall))

        def run(batches, probes=probes):
            known = probes.value
            for batch in slices(batches, "text"):
                hits = [list(x or ()) for x in batch.column("hits").to_pylist()]
                for r, i, end, d in matches(*tokens(batch.column("text")), known):
                    hits[r].append({"item_id": known.ids[i], "end": end, "distance": d})
                hits = [sorted(x, key=lambda y: (y["item_id"], y["end"])) for x in hits]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(hits, batch.schema.field("hits").type)], names=[*columns, "hits"])

        out = out.mapInArrow(run, schema)
    return out


def is_clean(hits: str = "hits") -> Column:
    return F.size(hits) == 0
