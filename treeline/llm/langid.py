"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the character
n-grams (one to three characters, lower-cased, hashed to ``SPACE`` places)
that occur in both, over the geometric mean of their own counts. Nyström
landmarks, some texts of each language, turn the kernel into a finite map;
one-versus-rest kernel ridge regression on it gives a score per language.
A batch is scored by two matrix products: n-gram presence by landmark
presence, then normalised kernel values by the ridge weights.

Every language with a learnable row is learned. Fitting reads at most
``PER_LANG`` texts of each (chosen by a hash of id and text; fewer where many
languages share ``SAMPLE_ROWS``), as the n-grams that occur in them, of which
``LANDMARKS`` are landmarks (fewer where many languages share
``MOST_LANDMARKS``; one of each at least). Scoring is one pass over whole
texts and moves no rows.

Defined cases: a text that is null, empty or without a letter is ``und``
with score 0; with no learnable row every text is ``und``; rows with a null
language or text are not learned from, those with a null id are (as long as
fold 0 isn't held out); rows that repeat id and text are learned from once and
identified alike; ties go to the language that sorts first; an empty table
gives no rows. Extra columns of the input are carried through unchanged, but
for ``lang_predicted`` and ``lang_score``, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import fold, mix, only, slices

ORDERS = (1, 2, 3)
SPACE = 1 << 18
PER_LANG = 250
LANDMARKS = 24
#: Rows that are learned from, and landmarks, of all languages together.
SAMPLE_ROWS, MOST_LANDMARKS = 8192, 2048
RIDGE = 0.05
BATCH = 128
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    places: np.ndarray  # n-gram places that occur in a landmark
    landmarks: np.ndarray  # places x landmarks, 1 where present
    norms: np.ndarray  # of the landmarks
    weights: np.ndarray  # landmarks + 1 x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        for a in range(0, len(known), BATCH):
            part = known[a : a + BATCH]
            found = [present(texts[i]) for i in part]
            presence = np.stack([f[self.places] for f in found]).astype(np.float32)
            own = np.sqrt([np.count_nonzero(f) for f in found])
            out = augmented(presence @ self.landmarks / (own[:, None] * self.norms)) @ self.weights
            best = out.argmax(1)
            for i, k, s in zip(part, best, np.clip(out[np.arange(len(part)), best], 0, 1), strict=True):
                names[i], scores[i] = self.langs[k], s
        return names, scores


def present(text: str) -> np.ndarray:
    """Which of the hashed n-grams of a whole text occur."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros(SPACE, np.uint8)
    rolled = np.zeros(len(codes) + 1, np.uint64)
    for n in range(1, max(ORDERS) + 1):
        rolled = rolled[:-1] * np.uint64(0x110003) + codes[n - 1 :]
        if n in ORDERS:
            out[(rolled * np.uint64(0x9E3779B97F4A7C15 + 2 * n) >> np.uint64(46)).astype(np.int64)] = 1
    return out


def augmented(kernel: np.ndarray) -> np.ndarray:
    return np.hstack([kernel, np.ones((len(kernel), 1))])


def train(found: list[np.ndarray], langs: list[str]) -> LanguageModel:
    """Nyström ridge regression: minimise |K w - y|^2 + ridge w' K_mm w for each language against the rest.

    ``found`` has each text's n-gram places."""
    names = sorted(set(langs))
    number = {n: k for k, n in enumerate(names)}
    y = np.zeros((len(langs), len(names)))
    y[np.arange(len(langs)), [number[x] for x in langs]] = 1
    most = min(LANDMARKS, max(1, MOST_LANDMARKS // len(names)))
    order = np.argsort(y.argmax(1), kind="stable")
    own = y.argmax(1)[order]
    chosen = order[np.arange(len(own)) - np.searchsorted(own, own) < most]
    places = np.unique(np.concatenate([found[i] for i in chosen]))
    landmarks, norms = np.zeros((len(places), len(chosen)), np.float32), np.sqrt([float(len(found[i])) for i in chosen])
    for k, i in enumerate(chosen):
        landmarks[np.searchsorted(places, found[i]), k] = 1
    between = landmarks.T.astype(np.float64) @ landmarks / np.outer(norms, norms)
    balance = (len(y) / (len(names) * y.sum(0)))[y.argmax(1)]
    left, right = np.zeros((len(norms) + 1, len(norms) + 1)), np.zeros((len(norms) + 1, len(names)))
    left[:-1, :-1] = RIDGE * (between + 1e-6 * np.eye(len(norms)))
    left += 1e-9 * np.eye(len(left))
    for a in range(0, len(found), BATCH):
        part = found[a : a + BATCH]
        presence = np.zeros((len(part), SPACE), np.uint8)
        for k, f in enumerate(part):
            presence[k, f] = 1
        rows = presence[:, places].astype(np.float32) @ landmarks / (np.sqrt([len(f) for f in part])[:, None] * norms)
        kernel, weight = augmented(rows), balance[a : a + BATCH, None]
        left += kernel.T @ (kernel * weight)
        right += kernel.T @ (y[a : a + BATCH] * weight)
    return LanguageModel(names, places, landmarks, norms, np.linalg.solve(left, right))


def fit(docs: DataFrame, folds: int = 3, held_out: int = 1, per_lang: int = PER_LANG) -> LanguageModel:
    """Learn from the text and language of documents outside the held-out fold."""
    known = only(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0) & (fold("doc_id", folds) != held_out))
    known = known.withColumn("h", F.xxhash64("doc_id", "text"))
    # Different rows, about; a row a language.
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not counts:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros((1, 0)))
    per_lang = max(1, min(per_lang, SAMPLE_ROWS // len(counts)))
    # A share of each language by a hash, so that no sort moves the texts; twice the aim and 40 more, so that none is left without, cut to the bound below.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], (2 * per_lang + 40) / r["n"])])
    place = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    some = known.where(place < F.try_element_at(share, F.col("lang")))
    # About 2 * per_lang + 40 keys a language are left; rows that repeat id and text count once, also where they are read.
    keys = some.select("lang", "h").distinct()
    top = keys.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= per_lang).drop("n")
    taken = some.join(F.broadcast(top), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def occurring(batches):
        for batch in batches:
            for part in slices([batch]):
                places = [np.flatnonzero(present(t)).astype(np.int32) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_pydict({"lang": part["lang"], "h": part["h"], "places": pa.array(places, pa.list_(pa.int32()))})

    table = taken.mapInArrow(occurring, "lang string, h long, places array<int>").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    model = train([x.values.to_numpy() for x in table["places"]], table["lang"].to_pylist())
    del table
    pa.default_memory_pool().release_unused()  # the driver doesn't keep the sample
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with ``lang_predicted`` and ``lang_score``."""
    docs = docs.drop("lang_predicted", "lang_score")
    schema = docs.select("*", F.lit("").alias("lang_predicted"), F.lit(0.0).alias("lang_score")).schema

    def found(batches):
        for part in slices(batches):
            names, scores = model.predict(part["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(found, schema)
