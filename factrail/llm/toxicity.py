"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

Voters look at a text and say yes or nothing: learned lexicon entries (words, and stems of 4 and 5 bytes, whose share of
toxic rows is surely high), fixed insult words, and patterns (address next to an insult, masked words, shouting, repeated
marks). The label model is a two-class mixture fitted by expectation maximisation: it estimates each voter's rate of
saying yes in either class, with the given label as one more, fallible voter, and the correlation of voters within the
classes; a voter's evidence is divided by how much of it others repeat. The label's rates are estimated like all others; as
many assumed rows as LABEL_WEIGHT in either class start them at LABEL_RATES, which ties the positive class to its meaning. Voters
overrule a label that they contradict. The classifier is a logistic regression of lexicon entries and voters on the posterior labels.

Training: the lexicon is counted in Spark over all labelled rows outside the held-out fold, whole texts; the label model and
the classifier are fitted on at most TRAIN_ROWS of them (chosen by a digest of the id). The driver gets the strongest ENTRIES entries
and one packed row of votes per training text. A score uses the text only.

Cases: a null or empty text has no votes and gets the score of a text without any entry; without toxic labels every score
is 0; rows that repeat are scored alike; a row with several labels counts as toxic if one of them says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factrail.llm.blocks import LETTERS, batches_of, hash_nested, lowered, mix, spans, text_blocks
from factrail.llm.common import held_out, materialise

#: Bound of the training sample.
TRAIN_ROWS = 20_000
ENTRIES = 1500
VOTERS = 64
MIN_ROWS = 4
#: How often a given label says toxic in either class, to begin with, and how many rows of each class that is worth.
LABEL_RATES = (0.01, 0.98)
LABEL_WEIGHT = 20.0
#: Lexicon entries: how far the lower bound of their log odds must lie above those of all rows.
ODDS_GAIN = 1.2
#: Bit maps of labelled ids that are broadcast at most (8 KB each, for 32 768 neighbouring ids); with more, texts are shuffled.
MAP_ROWS = 8192
STEPS = 300
RATE = 0.2
L2 = 2e-4

# fixed values: common insults that vote whatever the labels say
INSULTS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile",
           "dummkopf", "idiota", "imbécile", "estúpido", "blöd", "abschaum")
_INSULT = "|".join(INSULTS)
PATTERNS = (
    re.compile(rf"\b(?:you|your|du|ihr|tu|vous|tú|usted)\b[^.!?\n]{{0,40}}\b(?:{_INSULT})\b"),
    re.compile(r"\b[a-z]+\*{2,}[a-z]*\b"),
    re.compile(r"!{3,}"),
    re.compile(rf"\b(?:{_INSULT})\b[^.!?\n]{{0,40}}\b(?:{_INSULT})\b"),
)
FIXED = len(PATTERNS) + 2


def _entries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Three entry hashes per word: the word and its stems (0 where the word is no longer than the stem)."""
    n = ends - starts
    word, four, five = hash_nested(data, starts, ends, (np.minimum(starts + 4, ends), np.minimum(starts + 5, ends)), fold=False)
    return np.stack((word, np.where(n > 4, mix(four + np.uint64(4)), np.uint64(0)), np.where(n > 5, mix(five + np.uint64(5)), np.uint64(0))), axis=1)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    for lo, offsets, data in text_blocks(lowered(texts)):
        row, starts, ends = spans(offsets, data, LETTERS)
        yield lo, offsets, data, row, _entries(data, starts, ends), len(offsets) - 1


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each class that hold an entry, added up per block."""
    schema = pa.schema([("entry", pa.int64()), ("toxic", pa.int64()), ("other", pa.int64())])
    for batch in batches:
        for lo, _, _, row, entries, rows in _blocks(batch.column(0)):
            toxic = batch.column(1).slice(lo, rows).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, owner = entries.ravel(), np.repeat(row, 3)
            keep = flat != 0
            flat, owner = flat[keep], owner[keep]
            order = np.lexsort((owner, flat))
            flat, owner = flat[order], owner[order]
            new = np.concatenate(([True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1]))) if len(flat) else np.zeros(0, bool)
            flat, owner = flat[new], owner[new]
            entry, at = np.unique(flat, return_inverse=True)
            yes = np.bincount(at, weights=toxic[owner], minlength=len(entry)).astype(np.int64)
            yield batches_of(schema, (entry.view(np.int64), yes, np.bincount(at, minlength=len(entry)) - yes))


class Lexicon:
    """Entries by hash; lookup in a table of twice their number's next power of four."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.sort(entries.astype(np.uint64))
        self.bits = np.uint64(16)
        self.possible = np.zeros(1 << 16, bool)
        self.possible[(self.entries >> np.uint64(48)).astype(np.int64)] = True

    def find(self, row: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, entry number) pairs that occur."""
        flat, owner = entries.ravel(), np.repeat(row, 3)
        maybe = np.flatnonzero(self.possible[(flat >> np.uint64(48)).astype(np.int64)])
        flat, owner = flat[maybe], owner[maybe]
        if not len(self.entries) or not len(flat):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.entries, flat), len(self.entries) - 1)
        hit = self.entries[at] == flat
        pair = np.unique(owner[hit].astype(np.int64) * len(self.entries) + at[hit])
        return pair // len(self.entries), pair % len(self.entries)


def _fixed_votes(offsets: np.ndarray, data: np.ndarray, raw: list[str], rows: int) -> np.ndarray:
    """Votes of the patterns, of any fixed insult, and of shouting. A pattern runs only over texts with an insult or its mark."""
    out = np.zeros((rows, FIXED), bool)
    text = data.tobytes()
    for i in range(rows):
        part = text[offsets[i] : offsets[i + 1]]
        if b"!!!" in part:
            out[i, 2] = True
        if b"**" in part:
            out[i, 1] = PATTERNS[1].search(part.decode("utf-8", "replace")) is not None
        if any(w in part for w in _INSULT_BYTES):
            s = part.decode("utf-8", "replace")
            out[i, 0] = PATTERNS[0].search(s) is not None
            out[i, 3] = PATTERNS[3].search(s) is not None
            out[i, 4] = True
        if raw is not None:
            out[i, 5] = raw[i]
    return out


_INSULT_BYTES = [w.encode() for w in INSULTS]


def _shouts(texts: pa.Array, lo: int, rows: int) -> np.ndarray:
    """More capital than small ASCII letters."""
    out = np.zeros(rows, bool)
    for at, offsets, data in text_blocks(texts.slice(lo, rows)):
        up = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
        down = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122))))
        out[at : at + len(offsets) - 1] = (up[offsets[1:]] - up[offsets[:-1]]) > (down[offsets[1:]] - down[offsets[:-1]])
    return out


def _votes(texts: pa.Array, lexicon: Lexicon) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row and entry of each hit, fixed votes) per block."""
    for lo, offsets, data, row, entries, rows in _blocks(texts):
        owner, entry = lexicon.find(row, entries)
        yield lo, rows, owner, entry, _fixed_votes(offsets, data, _shouts(texts, lo, rows), rows)


def _training_rows(lexicon: Lexicon):
    schema = pa.schema([("toxic", pa.int32()), ("hits", pa.list_(pa.int32())), ("fixed", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, rows, owner, entry, fixed in _votes(batch.column(0), lexicon):
                cuts = np.searchsorted(owner, np.arange(rows + 1))
                hits = [entry[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
                yield batches_of(schema, (batch.column(1).slice(lo, rows), hits, [np.flatnonzero(f).tolist() for f in fixed]))

    return run


def label_model(votes: np.ndarray, given: np.ndarray, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the positive class; each voter's rates (class 0, class 1); the share of its evidence that counts.

    The last voter is the given label, whose evidence counts in full.
    """
    v = np.concatenate((votes, given[:, None]), axis=1).astype(float)
    q = 0.02 + 0.96 * given
    share = np.ones(v.shape[1])
    for step in range(steps):
        weight = np.stack((1 - q, q))
        total = weight.sum(axis=1)
        rate = (weight @ v + 0.5) / (total[:, None] + 1.0)
        rate[:, -1] = (weight @ v[:, -1] + LABEL_WEIGHT * np.array(LABEL_RATES)) / (total + LABEL_WEIGHT)
        prior = (total[1] + 1) / (total.sum() + 2)
        if step >= 2:
            repeated = np.zeros((v.shape[1],) * 2)
            for c in (0, 1):
                d = v - rate[c]
                sd = np.sqrt(rate[c] * (1 - rate[c]))
                repeated = np.maximum(repeated, (d * weight[c][:, None]).T @ d / max(total[c], 1.0) / np.outer(sd, sd))
            np.fill_diagonal(repeated, 0.0)
            share = 1.0 / (1.0 + np.clip(repeated[:, :-1], 0.0, 1.0).sum(axis=1))
            share[-1] = 1.0
        yes = share * np.log(rate[1] / rate[0])
        no = share * np.log((1 - rate[1]) / (1 - rate[0]))
        logit = np.log(prior / (1 - prior)) + v @ yes + (1 - v) @ no
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q, rate[0], rate[1], share


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias


def _classifier(features: list[np.ndarray], size: int, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels (full-batch, Adam)."""
    row = np.repeat(np.arange(len(features)), [len(x) for x in features])
    col = np.concatenate(features).astype(np.int64) if features else np.zeros(0, np.int64)
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = np.bincount(row, weights=w[col], minlength=len(features)) + b
        slope = target - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(col, weights=slope[row], minlength=size) / len(features) - L2 * w
        gb = slope.mean()
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        mb += 0.1 * (gb - mb)
        vb += 0.01 * (gb * gb - vb)
        w += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b += RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w, b


def _labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(text, toxic) of the rows of docs whose id is among known (doc_id, toxic), without moving a text where exact bit maps
    of the ids are small enough to be broadcast."""
    place, number = F.bitmap_bit_position("doc_id"), F.bitmap_bucket_number("doc_id").alias("number_")
    ids = known.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    maps = ids.groupBy(number).agg(F.bitmap_construct_agg(place).alias("known_"), F.bitmap_construct_agg(F.when(F.col("toxic") == 1, place)).alias("toxic_"))
    numbers = ids.select(number).distinct().count()
    if numbers > MAP_ROWS:
        return texts.join(ids, "doc_id").select("text", "toxic")

    def bit(name):
        octet = F.conv(F.hex(F.substring(name, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.pmod(F.floor(octet / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)).cast("int")

    marked = texts.withColumn("number_", number).join(F.broadcast(materialise(maps)), "number_")
    return marked.where(bit("known_") == 1).select("text", bit("toxic_").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fits a model on docs (doc_id, text) and labels (doc_id, toxic)."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total, positive = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not positive:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < rows / total).orderBy(draw, "doc_id").limit(rows + rows // 8)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")  # bounded by `rows`
    counts = _labelled(docs, known).mapInArrow(_count_entries, "entry bigint, toxic bigint, other bigint").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("other") + 0.5)) - 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    floor = float(np.log(positive / max(total - positive, 1)))
    best = counts.where(F.col("toxic") >= MIN_ROWS).withColumn("odds", odds).where(F.col("odds") > floor + ODDS_GAIN).orderBy(F.desc("odds"), "entry").limit(ENTRIES).collect()
    lexicon = Lexicon(np.array([r.entry for r in best], dtype=np.int64).view(np.uint64))
    strongest = np.array([r.entry for r in best[:VOTERS]], dtype=np.int64).view(np.uint64)
    voter = np.searchsorted(lexicon.entries, strongest)
    data = texts.mapInArrow(_training_rows(lexicon), "toxic int, hits array<int>, fixed array<int>").collect()
    if not data:
        return None
    size = len(lexicon.entries)
    hits = np.zeros((len(data), size), bool)
    fixed = np.zeros((len(data), FIXED), bool)
    for i, r in enumerate(data):
        hits[i, r.hits] = True
        fixed[i, r.fixed] = True
    posterior, *_ = label_model(np.concatenate((hits[:, voter], fixed), axis=1), np.array([r.toxic for r in data]))
    features = [np.array(r.hits + [size + k for k in r.fixed], dtype=np.int64) for r in data]
    return Model(lexicon, *_classifier(features, size + FIXED, posterior))


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        size = len(model.lexicon.entries)
        for batch in batches:
            for lo, rows, owner, entry, fixed in _votes(batch.column(2), model.lexicon):
                z = model.bias + np.bincount(owner, weights=model.weights[entry], minlength=rows) + fixed @ model.weights[size:]
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield batches_of(_OUT, (batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows), score, (score >= 0.5).astype(np.int32)))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    model = model or train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(shared), "doc_id bigint, held_out boolean, score double, predicted int")
