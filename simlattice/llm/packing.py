"""Best-fit packing of token sequences.

Lengths are at most the capacity, so their histogram is a small table however many documents there are, and packing it is
planned on the driver. The plan is the configuration linear program (a configuration is a multiset of lengths that fits one
sequence; cover every length's count by as few configurations as possible), solved by multiplicative weights: lengths that are
covered least weigh most, a knapsack dynamic program prices the configurations, and the best dual prices give a bound that no
packing can beat. It is rounded and solved again on what is left; the little that then remains is packed best fit, decreasing,
a configuration at a time. Each configuration takes ranges of each length's pieces, so Spark places every piece by its rank
within its length and one join with the plan.
"""

from __future__ import annotations

import json
import logging
import math
import os
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import flat, ranked, slices, staged

log = logging.getLogger(__name__)

#: Chunks between blanks whose ids a task remembers, and the longest chunk that it remembers, in characters.
REMEMBERED, LONGEST = 100_000, 64
#: Letters whose lower case is one letter and which no composition changes, and the ASCII signs.
_LETTERS = "".join(chr(c) for c in range(0x41, 0x250) if chr(c).isalpha() and (c < 0x80 or c >= 0xC0) and c != 0x130)
_SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
#: Fixed value: what a vocabulary by words splits a text into; no alternative holds white space, and letters stay together.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_known: dict[str, tuple] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


def _tokenizer(path: str):
    """The tokenizer, the byte letters if its ids are those of chunks between blanks (else None), and the remembered ids of chunks."""
    if path not in _known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        _known[path] = made, _byte_letters() if _by_chunk(json.loads(made.to_str())) else None, {}
    return _known[path]


def _by_chunk(rules: dict) -> bool:
    """Whether a text's ids are those of its chunks between blanks, by the vocabulary's own rules: composition, blanks, lower case;
    then a split that drops white space; and no added token that blanks or neighbours decide about."""
    steps = [(s["type"], s.get("pattern"), s.get("content")) for s in (rules["normalizer"] or {}).get("normalizers", [])]
    parts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and [p["type"] for p in parts] == ["Split", "ByteLevel"]
        and (parts[0]["pattern"], parts[0]["behavior"], parts[0]["invert"]) == ({"Regex": _SPLIT}, "Removed", True)
        and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or set(" \n") & set(t["content"]) or not set(t["content"]) - set(_LETTERS + _SIGNS) and not set(t["content"].rstrip(_SIGNS)) - set(_LETTERS) for t in rules["added_tokens"])
    )


def _encode(made, chunks: list[str]) -> list[bytes]:
    return [array("I", x.ids).tobytes() for x in made.encode_batch_fast(chunks, add_special_tokens=False)]


def _remembered(keys: list[str], known: dict[str, bytes], encode) -> np.ndarray:
    """The ids of each key; what is not known is encoded, and remembered if it is not long."""
    got = list(map(known.get, keys))
    new = [k for k, ids in enumerate(got) if ids is None]
    for k, ids in zip(new, encode([keys[k] for k in new]), strict=True):
        got[k] = ids
        if len(keys[k]) <= LONGEST:
            known[keys[k]] = ids
    out = np.empty(len(got), object)
    out[:] = got
    return out


def _listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _chunk_ids(chunks: pa.Array, made, letters: dict[int, str], known: dict[str, bytes]) -> np.ndarray:
    """The ids of distinct chunks. One of plain letters and signs after them is its word and its signs: the vocabulary's own model
    encodes the word, in lower case. The tokenizer encodes whatever else there is, as it stands."""
    tokenize = made.model.tokenize

    def words(own: list[str]) -> list[bytes]:
        return [array("I", [t.id for t in tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(letters))]).tobytes() for x in own]

    def whole(own: list[str]) -> list[bytes]:
        return _encode(made, own)

    bare = pc.utf8_rtrim(chunks, _SIGNS)
    plain = pc.and_(pc.equal(pc.utf8_ltrim(bare, _LETTERS), ""), pc.and_(pc.not_equal(bare, ""), pc.less_equal(pc.binary_length(chunks), LONGEST)))
    is_plain = plain.to_numpy(zero_copy_only=False)
    out = np.empty(len(chunks), object)
    out[~is_plain] = _remembered(_listed(chunks.filter(pc.invert(plain))), known, whole)
    own = pc.utf8_lower(bare.filter(plain)).dictionary_encode()
    ids = _remembered(_listed(own.dictionary), known, words)[own.indices.to_numpy()]
    signed = pc.greater(pc.binary_length(chunks), pc.binary_length(bare)).filter(plain)
    signs = pc.utf8_ltrim(chunks.filter(plain).filter(signed), _LETTERS).dictionary_encode()
    ids[signed.to_numpy(zero_copy_only=False)] += _remembered(_listed(signs.dictionary), known, whole)[signs.indices.to_numpy()]
    out[is_plain] = ids
    return out


def token_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and where each text's begin (one more than texts). A null text is empty.

    Where the vocabulary's rules allow it, texts are cut at blanks and line ends, each distinct chunk is encoded once, and ids are
    gathered by chunk number; else whole texts are encoded. tests hold this against whole texts.
    """
    made, letters, known = _tokenizer(path)
    if letters is None:
        raw = _encode(made, [x or "" for x in column.to_pylist()])
        return np.frombuffer(b"".join(raw), "<u4"), np.cumsum([0, *(len(x) // 4 for x in raw)])
    data, starts = flat(column)
    blank = (data == 32) | (data == 10)
    at, text = np.flatnonzero(blank), data[~blank]
    begin = starts - np.searchsorted(at, starts)  # where rows start once blanks are gone
    edge = np.zeros(len(text) + 1, bool)
    edge[at - np.arange(len(at))] = True
    edge[begin] = True
    edge[[0, -1]] = True
    edges = np.flatnonzero(edge)
    if len(edges) < 2:
        return np.zeros(0, "<u4"), np.zeros(len(starts), np.int64)
    chunks = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))).dictionary_encode()
    if len(known) + len(chunks.dictionary) > REMEMBERED:
        known.clear()
    raw = _chunk_ids(chunks.dictionary, made, letters, known).tolist()
    table, many = np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    which = chunks.indices.to_numpy()
    n = many[which]
    ends = np.cumsum(n)
    ids = table[np.repeat((np.cumsum(many) - many)[which] - ends + n, n) + np.arange(ends[-1])]
    return ids, np.r_[0, ends][np.searchsorted(edges, begin)]


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    ids, starts = token_ids(pa.array(texts, pa.string()), path)
    return [ids[a:b].tobytes() for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        for batch in slices(batches, "text", 1_500_000):
            ids, starts = token_ids(batch.column("text"), path)
            ids = np.insert(ids, starts[1:], end_id)
            starts = starts + np.arange(len(starts))
            many = -(-np.diff(starts) // capacity)
            row = np.repeat(np.arange(batch.num_rows), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            begin = starts[row] + piece * capacity
            end = np.minimum(begin + capacity, starts[row + 1])
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(end - begin), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        _tokenizer(path)[2].clear()  # a worker outlives its task

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The ids of each text and end_id, cut into pieces of at most capacity ids; a null text is empty."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _priced(worth: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Knapsack: the most worth for every capacity up to the given one, and the length that was put in last (-1: none).

    worth is by length, minus infinity where there is no piece of it."""
    best, last = np.zeros(capacity + 1), [-1] * (capacity + 1)
    for c in range(1, capacity + 1):
        with_it = best[c - 1 :: -1] + worth[1 : c + 1]
        at = int(with_it.argmax())
        best[c] = best[c - 1]
        if with_it[at] > best[c]:
            best[c], last[c] = with_it[at], at + 1
    return best, last


def _filling(last: list[int], c: int) -> list[int]:
    out = []
    while c > 0:
        if last[c] > 0:
            out.append(last[c])
            c -= last[c]
        else:
            c -= 1
    return out


def _worths(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    out = np.full(capacity + 1, -np.inf)
    out[lengths] = values
    return out


def _prices(lengths: np.ndarray, n: np.ndarray, capacity: int, pricings: int, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """The best dual prices found, and their bound: no covering of the counts n takes fewer sequences.

    Prices begin at a length's share of a sequence. Each pricing's best configuration is used for some of what its scarcest length
    needs, and a price falls exponentially with the cover of its length; scaled so that no configuration is worth more than
    one sequence, prices are dual feasible."""
    cover, best, least, since = np.zeros(len(lengths)), lengths / capacity, 0.0, 0
    index = np.zeros(capacity + 1, np.int64)
    index[lengths] = np.arange(len(lengths))
    for _ in range(pricings):
        price = lengths / capacity * np.exp(-rate * (cover - cover.min()))
        worth, last = _priced(_worths(lengths, price, capacity), capacity)
        price = price / worth[capacity]
        bound = float(n @ price)
        since += 1
        if bound > least * (1 + 1e-4):
            since = 0
        if bound > least:
            best, least = price, bound
        if since >= 6 or bound >= n.sum():
            break
        at, many = np.unique(index[_filling(last, capacity)], return_counts=True)
        cover[at] += (n[at] / many).min() / 2 * many / n[at]
    return best, least


def _relaxed(counts: np.ndarray, capacity: int, pricings: int, at_once: int, rate: float = 0.3, slack: float = 1e-2) -> tuple[dict[tuple[int, ...], float], float]:
    """How often to use which configuration, in fractions, and the dual bound: multiplicative weights on the covering program.

    Weights fall with the cover of a length and scale its dual price; one knapsack table prices the best configuration around every
    length. Those that are worth a whole sequence in dual prices, as all of an optimal solution are, are used for half of what
    their scarcest length still lacks, the least covered lengths first. Prices by size are exact, others are good to `slack`."""
    lengths = np.flatnonzero(counts)
    n = counts[lengths].astype(float)
    dual, bound = _prices(lengths, n, capacity, pricings)
    if bound <= n @ lengths / capacity * (1 + 1e-4):
        dual, slack = lengths / capacity, 1e-9
    price = _worths(lengths, dual, capacity)
    lacks, used = dict(zip(lengths.tolist(), n.tolist(), strict=True)), {}
    for _ in range(pricings):
        left = np.array(list(lacks.values()))
        cover = 1 - left / n
        open_ = left >= 0.05  # what is covered is in no further configuration; of equal worths, fewer pieces
        if not open_.any():
            break
        _, last = _priced(_worths(lengths[open_], (dual * np.exp(-rate * (cover - cover.min())) - 1e-6)[open_], capacity), capacity)
        filled, k = [0.0], 0  # fillings in dual prices
        for c in range(1, capacity + 1):
            filled.append(filled[c - last[c]] + price[last[c]] if last[c] > 0 else filled[-1])
        tight = open_ & (dual + np.array(filled)[capacity - lengths] >= 1 - slack)
        for i in np.argsort(cover, kind="stable")[: 4 * at_once]:
            if not tight[i]:
                continue
            own = [int(lengths[i]), *_filling(last, capacity - int(lengths[i]))]
            many = Counter(own)
            step = min(lacks[x] / m for x, m in many.items()) / 2
            if step < 0.02:
                continue
            own = tuple(sorted(own, reverse=True))
            used[own] = used.get(own, 0.0) + step
            for x, m in many.items():
                lacks[x] -= step * m
            k += 1
            if k >= at_once:
                break
        if not k:
            break
    return used, bound


def plan(histogram: dict[int, int], capacity: int = 2048, rounds: int = 8, pricings: int = 40, at_once: int = 200) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (lengths, longest first) and how often to use each; together they use every piece exactly once.

    The work and the plan's size depend on capacity, rounds, pricings and at_once only, not on the counts.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(own: tuple[int, ...], most: int) -> int:
        many = Counter(own)
        k = min(most, *(int(left[x]) // m for x, m in many.items()))
        if k > 0:
            for x, m in many.items():
                left[x] -= k * m
            out.append((own, k))
        return max(k, 0)

    full = take((capacity,), int(left[capacity])) if left[capacity] else 0
    least, by_program = None, 0
    for _ in range(rounds):
        before = left.sum()
        if not before:
            break
        used, bound = _relaxed(left, capacity, pricings, at_once)
        least = full + math.ceil(bound - 1e-6) if least is None else least
        # rounded in one order, so that the sum of all stays what it is; what the counts do not allow is left for the next round
        carry = 0.5
        for own, x in sorted(used.items(), key=lambda x: (-x[1], x[0])):
            carry += x
            by_program += take(own, int(carry))
            carry -= int(carry)
        if left.sum() > 0.9 * before:
            break
    # best fit, decreasing: the longest piece left, with the fullest filling of the rest from what is left
    while left.any():
        own = [int(np.flatnonzero(left)[-1])]
        left[own[0]] -= 1
        own += _fullest(left, capacity - own[0])
        left[own[0]] += 1
        take(tuple(sorted(own, reverse=True)), 1 << 62)
    log.info("%d sequences, %d full pieces, %d by the program; the dual bound is %d", sum(k for _, k in out), full, by_program, least or full)
    return out


def _fullest(left: np.ndarray, room: int) -> list[int]:
    """Lengths that are left and fill the room: one that fits exactly, else the longer of two that do, else the longest."""
    free, out = left[: room + 1].copy(), []
    while room > 0:
        have = np.flatnonzero(free[: room + 1])
        if not len(have):
            break
        if free[room]:
            return [*out, room]
        both = have[(free[room - have] > (room - have == have)) & (have >= room - have)]
        out.append(int(both[-1] if len(both) else have[-1]))
        free[out[-1]] -= 1
        room -= out[-1]
    return out


def pack(parts: DataFrame, capacity: int = 2048, **how) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and any others): gapless in sequences of at most capacity.

    parts is read more than once: give a staged table. Equal (doc_id, piece, length) rows are interchangeable. A null
    doc_id is packed as any other. Extra columns pass through; sequence_id and offset are replaced. Empty in, empty out.
    """
    parts = parts.drop("sequence_id", "offset")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, at, used = [], 0, {}
    for own, k in plan(histogram, capacity, **how):
        lengths, many = np.unique(own, return_counts=True)
        start = 0
        for length, a in zip(lengths.tolist(), many.tolist(), strict=True):
            lo = used.get(length, 0)
            rows.append((length, lo, lo + a * k, at, a, start))
            used[length] = lo + a * k
            start += a * length
        at += k
    spark = parts.sparkSession
    places = spark.createDataFrame(rows, "length long, lo long, hi long, seq long, many long, begin long")
    keyed = parts.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    keyed = ranked(keyed, ["length"], ["_id", "piece"], "_rank").drop("_id")
    # the plan has as many rows as capacity and its parameters allow, whatever the input
    out = keyed.join(F.broadcast(places), (keyed["length"] == places["length"]) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))).drop(places["length"])
    nth = F.col("_rank") - F.col("lo")
    return out.select(*parts.columns, (F.col("seq") + F.expr("(_rank - lo) div many")).alias("sequence_id"), (F.col("begin") + nth % F.col("many") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, **how) -> DataFrame:
    """pack() over the pieces of docs (doc_id, text); other columns are not read."""
    return pack(staged(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity, **how)
