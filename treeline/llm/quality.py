"""Quality classifier: supervised subword embeddings with a softmax output.

Every word gives hashed features: the word itself, its character n-grams
(with word ends) and the bigram with the word before it. A text is the
average of its features' learned vectors. Vectors and output layer are
trained together by stochastic gradient descent in numpy.

Fitting reads at most ``per_class`` labelled texts of each class, chosen by
a hash of the id, one text an id. The sample is weighted back to the label frequencies of
all learnable rows, so scores stay probabilities. Scoring is one pass over
the texts and moves no rows.

Defined cases: null and empty texts have no features and score by the
output bias alone (a text with no words is as likely as the bias says);
null labels and labels outside 0 and 1 are not learned from; a doc_id with
contradicting labels is learned from with each of them; of a doc_id with
several texts one is learned from (least hash); repeated rows score alike, and
equal scores are judged alike; with no learnable row, or only one class, every
text scores the share of label 1 (0.5 with no label at all); an empty table
gives no rows. Extra columns of the input are carried through unchanged, but
for ``quality_score`` and ``quality_predicted``, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import coded_words, codepoints, fold, mix, only, segment_sums, slices, word_hashes

BUCKETS = 1 << 16
DIM = 8
NGRAMS = (3, 4, 5, 6)
PER_CLASS = 1000
EPOCHS = 5
#: A small sample is gone through more often, up to about so many steps.
LEAST_STEPS = 600
THRESHOLD = 0.3
#: Distinct words whose n-grams are held at a time.
WORDS_AT_ONCE = 8192


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 for each text."""
        codes, starts, distinct = coded_words(texts)
        sums, counts = np.zeros((len(distinct), DIM)), np.zeros(len(distinct))
        for a in range(0, len(distinct), WORDS_AT_ONCE):
            owner, bucket = subwords(distinct[a : a + WORDS_AT_ONCE])
            ends = np.searchsorted(owner, np.arange(len(distinct[a : a + WORDS_AT_ONCE])))
            sums[a : a + len(ends)] = np.add.reduceat(self.vectors[bucket], ends)
            counts[a : a + len(ends)] = np.diff(np.append(ends, len(owner)))
        pairs = bigrams(word_hashes(distinct), codes, starts)
        total = segment_sums(sums[codes] + self.vectors[pairs], starts)
        number = segment_sums(counts[codes] + 1, starts)
        z = total / np.maximum(number, 1)[:, None] @ self.output + self.bias
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -500, 500)))


def subwords(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every word and character n-gram of the distinct words, ordered by word."""
    flat, starts = codepoints([f"<{w}>" for w in distinct])
    word = np.repeat(np.arange(len(distinct)), np.diff(starts))
    owners, hashes = [np.arange(len(distinct))], [mix(word_hashes(distinct), 1)]
    rolled = flat.astype(np.uint64)
    for n in range(2, max(NGRAMS) + 1):
        if len(flat) < n:
            break
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + flat[n - 1 :]
        if n in NGRAMS:
            inside = word[: len(rolled)] == word[n - 1 :]
            owners.append(word[: len(rolled)][inside])
            hashes.append(mix(rolled[inside], n))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return owner[order], (np.concatenate(hashes)[order] % np.uint64(BUCKETS)).astype(np.int64)


def bigrams(hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bucket of each word with the one before it; a repeated word has one bucket of its own, whatever the word."""
    first = np.zeros(len(codes), bool)
    first[starts[:-1][starts[:-1] < len(codes)]] = True
    before = np.concatenate([codes[:1], codes[:-1]])
    joint = mix(hashes[codes] ^ mix(hashes[before], 7), 8) if len(codes) else np.zeros(0, np.uint64)
    joint[codes == before] = np.uint64(11)
    joint[first] = np.uint64(5)
    return (joint % np.uint64(BUCKETS)).astype(np.int64)


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and how often each occurs."""
    out = []
    for text in texts:
        codes, starts, distinct = coded_words([text])
        owner, bucket = subwords(distinct)
        weights = np.bincount(codes, minlength=len(distinct))
        both = np.concatenate([bucket, bigrams(word_hashes(distinct), codes, starts)])
        times = np.concatenate([weights[owner], np.ones(len(codes), np.int64)])
        kept, inverse = np.unique(both, return_inverse=True)
        out.append((kept, np.bincount(inverse, weights=times)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, rate: float = 1.0, seed: int = 7) -> QualityModel:
    """Minibatch gradient descent on the weighted softmax loss, with a linearly falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output, share = np.zeros((DIM, 2)), float(np.average(labels, weights=weights))
    bias = np.log(np.clip([1 - share, share], 1e-6, 1))
    size = 16
    batches = -(-len(rows) // size)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    for step in range(epochs * batches):
        if step % batches == 0:
            order = rng.permutation(len(rows))
        part = order[step % batches * size :][:size]
        lengths = [len(rows[i][0]) for i in part]
        at = np.concatenate([rows[i][0] for i in part])
        share_of = np.concatenate([rows[i][1] / max(1.0, rows[i][1].sum()) for i in part])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        hidden = segment_sums(vectors[at] * share_of[:, None], starts)
        z = hidden @ output + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(part)), labels[part]] -= 1
        error = p * (weights[part] / len(part))[:, None]
        falling = rate * (1 - step / (epochs * batches))
        back = np.repeat(error @ output.T, lengths, axis=0) * share_of[:, None]
        places, inverse = np.unique(at, return_inverse=True)
        for k in range(DIM):
            vectors[places, k] -= falling * size * np.bincount(inverse, weights=back[:, k])
        output -= falling * hidden.T @ error * size
        bias = bias - falling * 0.1 * error.sum(0)
    return QualityModel(vectors, output, bias)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> QualityModel:
    """Learn from labelled documents outside the held-out fold; ``per_class`` bounds the sample of each class."""
    known = only(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out)).distinct()
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        share = 0.5 if not counts else float(next(iter(counts)))
        return QualityModel(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 2)), np.log(np.clip([1 - share, share], 1e-6, 1)))
    top = [known.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    # At most per_class ids a class are broadcast, and one text of each is kept, so repeated ids can't flood the driver.
    sample = only(docs, "doc_id", "text").join(F.broadcast(top[0].unionByName(top[1])), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def counted(batches):
        for batch in batches:
            for part in slices([batch]):
                found = features(part["text"].to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "quality": part["quality"], "places": [x.astype(np.int32) for x, _ in found], "times": [y.astype(np.float32) for _, y in found]})

    table = sample.mapInArrow(counted, "doc_id long, quality int, places array<int>, times array<float>").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    y = table["quality"].to_numpy()
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 2)), np.log(np.clip([counts[0], counts[1]], 1, None) / sum(counts.values())))
    back = np.array([counts[c] / max(1, (y == c).sum()) for c in (0, 1)])[y]
    rows = [(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(table["places"], table["times"], strict=True)]
    model = train(rows, y, back / back.mean())
    del rows, table
    pa.default_memory_pool().release_unused()  # the driver doesn't keep the sample
    return model


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``quality_score`` and ``quality_predicted`` (1 from the threshold on)."""
    docs = docs.drop("quality_score", "quality_predicted")
    schema = docs.select("*", F.lit(0.0).alias("quality_score"), F.lit(0).alias("quality_predicted")).schema

    def scored(batches):
        for part in slices(batches, most=2 << 20):
            found = model.scores(part["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(scored, schema)
