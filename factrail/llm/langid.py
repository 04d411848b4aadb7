"""Language of whole texts by a linear-chain conditional random field over their words.

Features of a word: prefixes and suffixes of 1-3 bytes, byte 2- and 3-grams within its edges, and whether a learned lexicon
of each language's own frequent words holds it. Emission and transition weights are fitted together by maximum
likelihood on labelled text whose segments are strung together in random order, so transitions are learned from real
changes of language. Forward-backward gives every word of a text its posterior over languages, also in code-switched text;
a text's language is the one with the largest mean posterior, and its score is that mean.

Texts are cut into chunks only for speed: the product of each chunk's potentials carries the chain across, so the
posteriors are those of the whole sequence. Words repeat, so workers keep their emissions in a table of fixed size.

Training: at most TRAIN_ROWS labelled rows (chosen by a digest of the id, evenly over languages), whole texts, none of the
held-out fold. Prediction uses the text only.

Cases: a null text or one without any letter is `und` with score 0; without a labelled row everything is `und`; rows that
repeat are predicted alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from factrail.llm.blocks import LETTERS, batches_of, hash_spans, lowered, mix, spans, text_blocks
from factrail.llm.common import held_out

#: Bound of the training sample, over all languages together.
TRAIN_ROWS = 500
BUCKETS = 1 << 16
LEXICON = 400
SEGMENT = 48
STEPS = 40
RATE = 0.25
L2 = 1e-4
CHUNK = 64
SLOTS = 1 << 19
#: A text is rejected if no language holds this mean share of its words.
MIN_SCORE = 0.3


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], h: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, boundaries per word) of words; ids below BUCKETS are hashed, the next ones say which lexicon holds it."""
    n = ends - starts
    padded = np.zeros(int(n.sum()) + 2 * len(n), np.uint64)
    first = np.concatenate(([0], np.cumsum(n + 2)))
    at = np.repeat(first[:-1] + 1 - starts, n) + np.repeat(starts, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    source = np.repeat(starts, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    padded[at] = data[source]
    padded[first[:-1]] = 1
    padded[first[1:] - 1] = 2
    word = np.repeat(np.arange(len(n)), n + 2)
    place = np.arange(len(padded)) - first[word]
    left = n[word] + 2 - place
    owner, feature = [], []

    def add(rows: np.ndarray, value: np.ndarray, kind: int) -> None:
        owner.append(rows)
        feature.append((mix(value * np.uint64(31) + np.uint64(kind)) % np.uint64(BUCKETS)).astype(np.int64))

    two = padded[:-1] | padded[1:] << np.uint64(8) if len(padded) > 1 else padded[:0]
    three = two[:-1] | padded[2:] << np.uint64(16) if len(padded) > 2 else padded[:0]
    ok = left[: len(two)] >= 2
    add(word[: len(two)][ok], two[ok], 2)
    ok = left[: len(three)] >= 3
    add(word[: len(three)][ok], three[ok], 3)
    rows = np.arange(len(n))
    for size in (1, 2, 3):
        long = n >= size
        head, tail = np.zeros(int(long.sum()), np.uint64), np.zeros(int(long.sum()), np.uint64)
        for k in range(size):
            head |= padded[first[:-1][long] + 1 + k] << np.uint64(8 * k)
            tail |= padded[first[1:][long] - 2 - k] << np.uint64(8 * k)
        add(rows[long], head, 10 + size)
        add(rows[long], tail, 20 + size)
    known, language = lexicon
    if len(known):
        spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
        held = np.flatnonzero(known[spot] == h)
        owner.append(held)
        feature.append(BUCKETS + language[spot[held]])
    owner, feature = np.concatenate(owner), np.concatenate(feature)
    order = np.argsort(owner, kind="stable")
    return feature[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(n)))))


def emissions(weights: np.ndarray, feature: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Summed feature weights of each word, over the root of their number."""
    total = np.zeros((len(bounds) - 1, weights.shape[1]))
    if len(feature):
        total = np.add.reduceat(weights[feature], bounds[:-1], axis=0)
    return total / np.sqrt(np.maximum(np.diff(bounds), 1))[:, None]


def posteriors(emission: np.ndarray, row: np.ndarray, rows: int, transition: np.ndarray, start: np.ndarray, filtered: bool = False):
    """Forward-backward posteriors of words (ascending by row), by chunks whose transfer matrices chain a row together;
    if asked for, also the forward messages."""
    words, k = emission.shape
    if not words:
        return (emission, emission) if filtered else emission
    count = np.bincount(row, minlength=rows)
    per = -(-count // CHUNK)
    chunks = int(per.sum())
    base = np.concatenate(([0], np.cumsum(per)))
    place = np.arange(words) - np.concatenate(([0], np.cumsum(count)))[row]
    chunk, step = base[row] + place // CHUNK, place % CHUNK
    length = np.bincount(chunk, minlength=chunks)
    steps = int(length.max())
    order = np.argsort(-length, kind="stable")
    rank = np.empty(chunks, np.int64)
    rank[order] = np.arange(chunks)
    active = [int(np.searchsorted(-length[order], -t, side="left")) for t in range(steps)]  # chunks longer than t
    e = np.ones((steps, chunks, k))
    e[step, rank[chunk]] = np.exp(emission - emission.max(axis=1, keepdims=True))
    a = np.exp(transition - transition.max())
    transfer = np.broadcast_to(np.eye(k), (chunks, k, k)).copy()
    for t in range(steps):
        m = active[t]
        x = (transfer[:m].reshape(m * k, k) @ a).reshape(m, k, k) * e[t, :m, None, :]
        transfer[:m] = x / x.max(axis=(1, 2))[:, None, None]
    into = np.empty((chunks, k))
    after = np.ones((chunks, k))
    live = np.flatnonzero(per)
    now = np.broadcast_to(np.exp(start - start.max()), (len(live), k)).copy()
    for j in range(int(per.max())):
        keep = per[live] > j
        live, now = live[keep], now[keep]
        spot = rank[base[live] + j]
        into[spot] = now
        now = np.einsum("ni,nij->nj", now, transfer[spot])
        now /= now.sum(axis=1, keepdims=True)
    for j in range(int(per.max()) - 2, -1, -1):
        live = np.flatnonzero(per > j + 1)
        following = rank[base[live] + j + 1]
        x = np.einsum("nij,nj->ni", transfer[following], after[following])
        after[rank[base[live] + j]] = x / x.sum(axis=1, keepdims=True)
    forward = np.empty((steps, chunks, k))
    now = into
    for t in range(steps):
        m = active[t]
        x = (now[:m] @ a) * e[t, :m]
        now = x / x.sum(axis=1, keepdims=True)
        forward[t, :m] = now
    messages = forward[step, rank[chunk]] if filtered else None
    back = after.copy()
    for t in range(steps - 1, -1, -1):
        m = active[t]
        forward[t, :m] *= back[:m]
        x = (e[t, :m] * back[:m]) @ a.T
        back[:m] = x / x.sum(axis=1, keepdims=True)
    out = forward[step, rank[chunk]]
    out /= out.sum(axis=1, keepdims=True)
    return (out, messages) if filtered else out


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray, start: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]):
        self.languages, self.weights, self.transition, self.start, self.lexicon = languages, weights, transition, start, lexicon


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    for lo, offsets, data in text_blocks(lowered(texts)):
        row, starts, ends = spans(offsets, data, LETTERS)
        yield lo, row, starts, ends, hash_spans(data, starts, ends, fold=False), data, len(offsets) - 1


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fits the field to labelled texts (a bounded sample, on the driver)."""
    languages = sorted(set(labels))
    k = len(languages)
    index = {x: i for i, x in enumerate(languages)}
    doc_label = np.array([index[x] for x in labels])
    hashes, owner, pieces, sizes = [], [], [], []
    for lo, row, starts, ends, h, data, _ in _words(pa.array(texts, pa.large_string())):
        hashes.append(h)
        owner.append(row + lo)
        keep = np.unique(h, return_index=True)[1]
        pieces.append(b"".join(data[a:b].tobytes() for a, b in zip(starts[keep].tolist(), ends[keep].tolist())))
        sizes.append((h[keep], (ends - starts)[keep]))
    h, owner = np.concatenate(hashes), np.concatenate(owner)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    all_h, all_n = np.concatenate([x for x, _ in sizes]), np.concatenate([n for _, n in sizes])
    ends = np.cumsum(all_n)
    known, one = np.unique(all_h, return_index=True)
    word = np.searchsorted(known, h)
    y = doc_label[owner]
    # lexicon: each language's most frequent words that are mostly its own
    table = np.zeros((len(known), k))
    np.add.at(table, (word, y), 1.0)
    share = table / np.maximum(table.sum(axis=0), 1)
    own = share.argmax(axis=1)
    top = share.max(axis=1) >= 0.6 * share.sum(axis=1)
    chosen = np.concatenate([np.flatnonzero(top & (own == i))[np.argsort(-share[top & (own == i), i], kind="stable")[:LEXICON]] for i in range(k)])
    chosen = np.sort(chosen)
    lexicon = (known[chosen], own[chosen])
    starts, stops = (ends - all_n)[one], ends[one]
    ascending = np.argsort(starts, kind="stable")
    feature, bounds = word_features(data, starts[ascending], stops[ascending], lexicon, known[ascending], k)
    where = np.empty(len(known), np.int64)
    where[ascending] = np.arange(len(known))
    word = where[word]
    # segments in random order
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    segment = np.cumsum(np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] % SEGMENT == 0)))) - 1
    shuffled = np.random.default_rng(seed).permutation(int(segment[-1]) + 1)
    order = np.argsort(shuffled[segment], kind="stable")
    word, y = word[order], y[order]
    row = np.arange(len(word)) // (16 * CHUNK)
    rows = int(row[-1]) + 1
    inner = row[1:] == row[:-1]
    pair = np.zeros((k, k))
    np.add.at(pair, (y[:-1][inner], y[1:][inner]), 1.0)
    weights = np.zeros((BUCKETS + k, k))
    transition = np.zeros((k, k))
    # frequencies of labels in the sample are no prior of the field
    balance = len(y) / (k * np.maximum(np.bincount(y, minlength=k), 1))
    params = [weights, transition]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n_feats = np.sqrt(np.maximum(np.diff(bounds), 1))
    by_word = np.repeat(np.arange(len(known)), np.diff(bounds))
    truth = np.zeros((len(known), k))
    np.add.at(truth, (word, y), balance[y])
    for t in range(1, STEPS + 1):
        e = emissions(weights, feature, bounds)[word]
        gamma, forward = posteriors(e, row, rows, transition, np.zeros(k), filtered=True)
        expected = np.zeros((len(known), k))
        for i in range(k):
            expected[:, i] = np.bincount(word, weights=gamma[:, i] * balance[y], minlength=len(known))
        slope = (truth - expected) / n_feats[:, None] / len(word)
        grad = np.stack([np.bincount(feature, weights=slope[by_word, i], minlength=BUCKETS + k) for i in range(k)], axis=1) - L2 * weights
        # pairwise posteriors: forward message, transition, and what the second word's posterior adds to its prediction
        before, a = forward[:-1][inner], np.exp(transition)
        joint = before[:, :, None] * a[None] * (gamma[1:][inner] / np.maximum(before @ a, 1e-300))[:, None, :]
        joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-12)
        grads = [grad, (pair - joint.sum(axis=0)) / len(word) - L2 * transition]
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Model(languages, weights.astype(np.float32), transition, np.zeros(k), lexicon)


class _Memory:
    """Emissions of words in a worker, for one query at a time."""

    current: tuple[str, _Memory] | None = None

    def __init__(self, languages: int):
        self.keys = np.zeros(SLOTS, np.uint64)
        self.values = np.zeros((SLOTS, languages), np.float32)

    @classmethod
    def of(cls, query: str, languages: int) -> _Memory:
        if cls.current is None or cls.current[0] != query:
            cls.current = (query, cls(languages))
        return cls.current[1]


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _scored(texts: pa.Array, letters: np.ndarray, model: Model, memory: _Memory) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, best language, score, whether there is one) of each block."""
    k = len(model.languages)
    for lo, row, starts, ends, h, data, rows in _words(texts):
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        e = memory.values[slot].astype(np.float64)
        miss = np.flatnonzero(memory.keys[slot] != h)
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            ascending = np.argsort(one, kind="stable")
            new = miss[one[ascending]]
            found = emissions(model.weights, *word_features(data, starts[new], ends[new], model.lexicon, h[new], k))
            spot = np.empty(len(one), np.int64)
            spot[ascending] = np.arange(len(one))
            e[miss] = found[spot[back]]
            memory.keys[slot[new]] = h[new]
            memory.values[slot[new]] = found
        gamma = posteriors(e, row, rows, model.transition, model.start)
        mass = np.stack([np.bincount(row, weights=gamma[:, i], minlength=rows) for i in range(k)], axis=1)
        count = np.bincount(row, minlength=rows)
        known = letters[lo : lo + rows] & (count > 0)
        best = mass.argmax(axis=1)
        yield lo, best, np.where(known, np.clip(mass[np.arange(rows), best] / np.maximum(count, 1), 0, 1), 0.0), known


def _predict(shared, query: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memory = _Memory.of(query, len(model.languages))
        names = np.array(model.languages, dtype=object)
        for batch in batches:
            letters = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for lo, best, score, known in _scored(batch.column(2), letters, model, memory):
                yield batches_of(_OUT, (batch.column(0).slice(lo, len(best)), batch.column(1).slice(lo, len(best)), np.where(known, names[best], "und").tolist(), score))

    return run


def _filter(shared, query: str, min_score: float):
    """Rows (text, has letters, columns to keep) whose language is known with at least min_score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memory = _Memory.of(query, len(model.languages))
        for batch in batches:
            letters = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, best, score, known in _scored(batch.column(0), letters, model, memory):
                yield batch.slice(lo, len(best)).select([2]).filter(pa.array(known & (score >= min_score)))

    return run


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fits a model to at most about `rows` labelled rows of docs (doc_id, text, lang) outside the held-out fold."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = rows / len(counts)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, each / n))) for name, n in sorted(counts.items())])
    sample = usable.where(draw < share).orderBy(draw, "doc_id").limit(2 * rows).select("text", "lang").collect()
    if not sample:
        return None
    return fit([r.text for r in sample], [r.lang for r in sample])


def _has_letter(text):
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text; lang only to train)."""
    spark = docs.sparkSession
    model = model or train(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"), _has_letter(F.col("text")).alias("letters"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared, uuid.uuid4().hex), "doc_id bigint, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, min_score: float = MIN_SCORE, model: Model | None = None) -> DataFrame:
    """The rows, with all columns, whose language is known with at least min_score; no row moves."""
    model = model or train(docs)
    if model is None:
        return docs.where(F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("text"), _has_letter(F.col("text")).alias("letters_"), F.struct(*docs.columns).alias("row_"))
    kept = StructType([StructField("row_", docs.schema)])
    return rows.mapInArrow(_filter(shared, uuid.uuid4().hex, min_score), kept).select("row_.*")
