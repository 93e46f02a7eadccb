"""Language of texts by a linear-chain conditional random field over words.

A word's features are its affixes, its n-grams of bytes and, if it is in the lexicon learned with the model, the word itself; their
weights give each language's potential. Learned transitions tie neighbouring words, and forward-backward gives every word's
language in its context, so code-switched texts get a label word by word. A text's language is the one with most expected words.

Training texts have one language each; sequences that switch are made by joining stretches of texts of different languages, so that
transitions are learned as well. Fitting takes a bounded sample of each language's stretches, from whole texts of any length.

Forward-backward runs over all texts of a batch at once: texts are cut into segments, the product of transfer matrices of
each segment is found for all segments side by side, and texts are stitched by these products. It is exact for any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SPACE, flat, hashes, mix, slices, spans

#: Labelled rows are stretches of texts, of so many characters; about so many of each language are fitted.
SAMPLE, STRETCH = 400, 3000
TABLE = 1 << 16
SEGMENT = 128
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and where words with a letter start and end and in which row. Signs at a word's ends are cut off."""
    data, starts = flat(column)
    data = LOWER[data]
    begin, end, row = spans(data, starts, ~SPACE[data])
    if not len(begin):
        return data, begin, end, row
    letter = _LETTER[data]
    # the first letter at or after the start, the last before the end
    after = np.minimum.accumulate(np.where(letter, np.arange(len(data)), len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(letter, np.arange(len(data)), -1))
    begin, end = after[begin], before[end - 1] + 1
    real = begin < end
    return data, begin[real], end[real], row[real]


def word_features(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lexicon: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words, and how many each word has: n-grams of 1 to 4 bytes, prefixes and suffixes of up to 4, and
    the word if the lexicon has it."""
    length = end - begin
    n = len(begin)
    padded = length + 2
    start = np.r_[0, np.cumsum(padded)[:-1]]
    total = int(padded.sum())
    text = np.zeros(total, np.uint8)  # a zero byte on both sides marks the word's edges: an n-gram with it is an affix
    inner = np.arange(int(length.sum())) - np.repeat(np.r_[0, np.cumsum(length)[:-1]], length)
    text[np.repeat(start + 1, length) + inner] = data[np.repeat(begin, length) + inner]
    owner = np.repeat(np.arange(n), padded)
    left = np.repeat(start + padded, padded) - np.arange(total)
    found, who = [], []
    gram = np.zeros(total, np.uint64)
    for size in range(1, 6):
        ahead = np.zeros(total, np.uint64)
        ahead[: total - size + 1] = text[size - 1 :]
        gram = gram * np.uint64(257) + ahead + np.uint64(1)
        if size == 1:
            ok = text > 0
        elif size < 5:
            ok = left >= size
        else:  # with an edge only: affixes of four
            ok = (left >= size) & ((text == 0) | (left == size))
        found.append(((mix(gram[ok] + np.uint64(size << 56)) >> np.uint64(48)).astype(np.int64)) % TABLE)
        who.append(owner[ok])
    at = np.minimum(np.searchsorted(lexicon, word), max(0, len(lexicon) - 1))
    known = lexicon[at] == word if len(lexicon) else np.zeros(n, bool)
    found.append((mix(word[known]) >> np.uint64(48)).astype(np.int64) % TABLE)
    who.append(np.flatnonzero(known))
    found, who = np.concatenate(found), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return found[order], np.bincount(who, minlength=n)


def potentials(features: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of weights of each word's features, scaled by the root of their number."""
    if not len(counts):
        return np.zeros((0, weights.shape[1]))
    sums = np.add.reduceat(weights[features], np.r_[0, np.cumsum(counts)[:-1]], axis=0)
    return (sums / np.sqrt(counts)[:, None]).astype(float)


def marginals(scores: np.ndarray, row: np.ndarray, transitions: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Each word's probabilities given its whole row: forward-backward, exact. row is sorted."""
    ahead, back = _forward_backward(scores, row, transitions, segment)
    both = ahead * back
    return both / np.maximum(both.sum(axis=1, keepdims=True), 1e-300)


def _forward_backward(scores: np.ndarray, row: np.ndarray, transitions: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word's forward and backward vectors, each up to a factor."""
    n, k = scores.shape
    if not n:
        return scores, scores
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[first, n])
    parts = -(-size // segment)
    text = np.repeat(np.arange(len(first)), parts)
    nth = np.arange(len(text)) - np.repeat(np.r_[0, np.cumsum(parts)[:-1]], parts)
    begin = first[text] + nth * segment
    length = np.minimum(segment, first[text] + size[text] - begin)
    steps = int(length.max())
    order = np.argsort(-length, kind="stable")  # the longest first: those that are still running are a leading slice
    begin, length, text, nth = begin[order], length[order], text[order], nth[order]
    running = np.searchsorted(-length, -np.arange(steps), side="left")
    count = len(text)

    product = np.repeat(np.eye(k)[None], count, axis=0)
    for t in range(steps):
        m = running[t]
        new = (product[:m] @ move) * local[begin[:m] + t][:, None, :]
        product[:m] = new / new.max(axis=(1, 2), keepdims=True)
    into, out = np.full((count, k), 1.0 / k), np.ones((count, k))
    place = np.empty(count, np.int64)
    where = np.full((len(first), int(parts.max())), -1, np.int64)
    place[:] = np.arange(count)
    where[text, nth] = place
    # the first word has no transition: start from what move turns into even weights
    start = np.linalg.solve(move.T, np.ones(k)) if abs(np.linalg.det(move)) > 1e-9 else np.full(k, 1.0 / k)
    into[where[:, 0]] = start
    for j in range(1, where.shape[1]):
        own = where[:, j]
        own, before = own[own >= 0], where[own >= 0, j - 1]
        new = np.einsum("ij,ijk->ik", into[before], product[before])
        into[own] = new / np.abs(new).sum(axis=1, keepdims=True)
    for j in range(where.shape[1] - 2, -1, -1):
        after = where[:, j + 1]
        own, after = where[after >= 0, j], after[after >= 0]
        new = np.einsum("ijk,ik->ij", product[after], out[after])
        out[own] = new / new.max(axis=1, keepdims=True)
    ahead = np.empty((n, k))
    state = into
    for t in range(steps):
        m = running[t]
        new = (state[:m] @ move) * local[begin[:m] + t]
        state[:m] = new / np.abs(new).sum(axis=1, keepdims=True)
        ahead[begin[:m] + t] = state[:m]
    behind = np.empty((n, k))
    back = out
    for t in range(steps - 1, -1, -1):
        m = running[t]
        at = begin[:m] + t
        behind[at] = back[:m]
        new = (local[at] * back[:m]) @ move.T
        back[:m] = new / new.max(axis=1, keepdims=True)
    return np.maximum(ahead, 0), behind


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word's probabilities, and its row."""
        data, begin, end, row = tokens(column)
        if not len(begin):
            return np.zeros((0, len(self.languages))), row
        word = hashes(data, begin, end)
        _, one, which = np.unique(word, return_index=True, return_inverse=True)
        found = word_features(data, begin[one], end[one], self.lexicon, word[one])
        return marginals(potentials(*found, self.weights)[which], row, self.transitions), row

    def texts(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Each text's language and the share of its words that are expected in it."""
        rows = len(column)
        best, score = [UNKNOWN] * rows, np.zeros(rows)
        if self.languages:
            share, row = self.words(column)
            total = np.column_stack([np.bincount(row, share[:, j], rows) for j in range(len(self.languages))]) if len(row) else np.zeros((rows, len(self.languages)))
            n = total.sum(axis=1)
            for i in np.flatnonzero(n > 0):
                j = int(total[i].argmax())
                best[i], score[i] = self.languages[j], min(1.0, total[i, j] / n[i])
            # bytes beyond ASCII may be signs: a text without any letter has no language
            for i in np.flatnonzero(n > 0):
                text = column[int(i)].as_py()
                if not any(c.isalpha() for c in text):
                    best[i], score[i] = UNKNOWN, 0.0
        return best, score


def _sequences(rows: list[tuple[np.ndarray, int]], rng: np.random.Generator, many: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, languages and sequence numbers of made-up sequences that switch between texts."""
    words, tags, owner = [], [], []
    for k in range(many):
        left = length
        while left > 0:
            own, tag = rows[rng.integers(len(rows))]
            n = min(left, len(own), int(rng.geometric(1 / 12)) + 2)
            at = rng.integers(len(own) - n + 1)
            words.append(own[at : at + n])
            tags.append(np.full(n, tag))
            owner.append(np.full(n, k))
            left -= n
    return np.concatenate(words), np.concatenate(tags), np.concatenate(owner)


def fit(texts: list[str], tags: list[str], steps: int = 120, many: int = 48, length: int = 48, rate: float = 0.25, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fits by adaptive gradient steps on the likelihood of made-up sequences; the same texts give the same model."""
    languages = sorted(set(tags))
    if not languages:
        return Model([], np.zeros((TABLE, 1), np.float32), np.zeros((1, 1)), np.zeros(0, np.uint64))
    k = len(languages)
    column = pa.array(texts, pa.string())
    data, begin, end, row = tokens(column)
    if not len(begin):
        return Model(languages, np.zeros((TABLE, k), np.float32), np.zeros((k, k)), np.zeros(0, np.uint64))
    word = hashes(data, begin, end)
    distinct, one, which = np.unique(word, return_index=True, return_inverse=True)
    # the lexicon: words of at least three texts
    pairs = np.unique(np.column_stack([which, row]), axis=0)
    lexicon = distinct[np.bincount(pairs[:, 0], minlength=len(distinct)) >= 3] if len(distinct) else distinct
    features, counts = word_features(data, begin[one], end[one], lexicon, distinct)
    starts = np.r_[0, np.cumsum(counts)]
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    rows = [(which[at[i] : at[i + 1]], languages.index(tags[i])) for i in range(len(texts)) if at[i] < at[i + 1]]
    weights, transitions = np.zeros((TABLE, k)), np.zeros((k, k))
    seen, moved = np.full((TABLE, k), 1e-6), np.full((k, k), 1e-6)
    rng = np.random.default_rng(seed)
    if rows and k > 1:
        # every language is drawn as often as any other
        by = [[r for r in rows if r[1] == j] for j in range(k)]
        by = [b for b in by if b]
        for _ in range(steps):
            pool = [b[rng.integers(len(b))] for b in by for _ in range(8)]
            w, tag, owner = _sequences(pool, rng, many, length)
            unique, back = np.unique(w, return_inverse=True)
            n = counts[unique]
            own = features[np.repeat(starts[unique], n) + np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)]
            scores = potentials(own, n, weights)
            ahead, behind = _forward_backward(scores[back], owner, transitions, SEGMENT)
            share = ahead * behind
            share /= share.sum(axis=1, keepdims=True)
            error = -share
            error[np.arange(len(tag)), tag] += 1
            grad = np.zeros((len(unique), k))
            np.add.at(grad, back, error)
            grad /= np.sqrt(n)[:, None]
            spread = np.repeat(np.arange(len(unique)), n)
            full = np.column_stack([np.bincount(own, grad[spread, j], TABLE) for j in range(k)]) / many - decay * weights
            seen += full * full
            weights += rate * full / np.sqrt(seen)
            # expected moves between neighbours
            same = owner[1:] == owner[:-1]
            local = np.exp(scores[back] - scores[back].max(axis=1, keepdims=True))
            before, after, joint = ahead[:-1][same], (local * behind)[1:][same], np.zeros((k, k))
            for c in range(0, len(before), some := max(1, 4_000_000 // k**2)):  # many languages need many cells for each move
                own = before[c : c + some][:, :, None] * np.exp(transitions)[None] * after[c : c + some][:, None, :]
                joint += (own / own.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            true = np.zeros((k, k))
            np.add.at(true, (tag[:-1][same], tag[1:][same]), 1.0)
            step = (true - joint) / many - decay * transitions
            moved += step * step
            transitions += rate * 0.3 * step / np.sqrt(moved)
    return Model(languages, weights.astype(np.float32), transitions, lexicon)


def fold(of: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def train(docs: DataFrame, keep: Column, sample: int = SAMPLE, stretch: int = STRETCH) -> Model:
    """Fits to about `sample` labelled rows of each language. A row is a stretch of `stretch` characters: every text of
    docs(doc_id, text, lang) for which keep holds gives as many as it fills, and a hash chooses among all of them, wherever they stand. Rows with
    null text or lang are left out; every language counts."""
    rows = docs.select("doc_id", "text", "lang").filter(keep & F.col("lang").isNotNull() & F.col("text").isNotNull())
    many = F.greatest(F.ceil(F.length("text") / stretch), F.lit(1))
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(many).alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not count:
        return fit([], [])
    share = F.create_map(*[F.lit(x) for lang, n in count.items() for x in (lang, int(min(1.0, sample / n) * (1 << 30)))])
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    chosen = F.filter(F.sequence(F.lit(0), many.cast("int") - 1), lambda k: F.pmod(F.xxhash64(name, k), F.lit(1 << 30)) < F.element_at(share, F.col("lang")))
    parts = rows.select("lang", F.explode(F.transform(chosen, lambda k: F.substring(F.col("text"), k * stretch + 1, F.lit(stretch)))).alias("part"))
    got = sorted((r["lang"], r["part"]) for r in parts.collect())
    return fit([t for _, t in got], [lang for lang, _ in got])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score, from each whole text, to docs; columns of those names are replaced. A null text and one
    without a letter is `und` with score 0, and so is every text if nothing was learned. Rows are independent."""
    docs = docs.drop("lang_pred", "score")
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for batch in slices(batches, "text", 4_000_000):
            best, score = known.texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")
