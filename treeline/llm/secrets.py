"""Secret scan: candidates in whole texts, a random forest against false positives.

Candidates are runs of ``LEAST`` or more letters, digits and ``+/=_-``, and
from ``SHORTEST`` characters of any kind on, however many, the value that
follows a word such as ``password`` and ``=`` or ``:`` (up to the closing quote
of its line, or to white space), and the password of an address. Each has features of its length, its character transitions, the part
that dictionary words cover, and the path it stands in. What the words beside
it say is learned too: each hashed word has the log odds, shrunk to none for
rare words, of standing beside a secret among the labelled findings. A random
forest learned from those findings gives the probability that a candidate is a
secret. ``labelled_findings`` makes a labelled set by rule; any table of the
same columns can take its place. The dictionary is what the
corpus itself writes often: words of letters alone, by the number of
documents, counted over all of them.

Defined cases: null or empty texts have no candidates; a candidate at the
very start or end of a text has empty neighbouring words; of candidates that
overlap the longest is taken, then the first; equal candidates, in one text or
in repeated rows, are findings each, under null and repeated ids too; with
labels of one class only every finding gets that class; words of equal
frequency enter the dictionary in their order; an empty table has no findings
and an empty dictionary. Long texts are scanned whole. Other columns aren't
read. Values of secrets aren't returned, only their place, length and SHA-256.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import coded_words, only, slices, word_hashes

LEAST = 16
TREES = 40
DEPTH = 8
THRESHOLD = 0.5
SHORTEST = 6
#: Words of the dictionary, their least and greatest length, and the documents that have to write them.
WORDS, WORD_LENGTHS, LEAST_DOCS = 20_000, (4, 16), 3
CANDIDATE = re.compile(rf"[A-Za-z0-9+/=_-]{{{LEAST},}}")
_VALUE = f"{{{SHORTEST},}}"
KEYED = re.compile(rf"""(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|credentials?)["']?\s{{0,8}}[:=]>?\s{{0,8}}(?:"([^"\n]{_VALUE})"|'([^'\n]{_VALUE})'|([^\s"'<>]{_VALUE}))""")
ADDRESS = re.compile(rf"://[^\s/:@]{{1,64}}:([^\s/@]{_VALUE})@")
BESIDE = 48

# Plain words for made findings.
PLAIN = "about access account action address after again allow also always apple archive article author auto back base before black blue board book branch build button case change channel check city class client code color comment common config content copy country custom data date default delete demo design device document domain edit email entry error event example false field file find first flag folder form format from function general green group guide hand head height help here history home house image import index info input item java json keep kind label language large last left level library license light line link list local long look made main make manual master media member menu message method mode model month more music name network never news next night none note number object office open option order other page paper part pass path people phone photo place plan play point post print private process product profile project public query read record remote report request result return right root sample save script search section security select send server service session setting share simple site size some sort source start state store string style sub summary support system table target team temp test text that their them then there this time title tool total track type under unit update upload user value version video view water week white width with word work world write year your".split()

FEATURES = ["length", "class_changes", "letter_digit_changes", "vowel_turns", "entropy", "digit_share", "upper_share", "symbol_share", "hex_only", "dictionary_cover", "slashes", "in_path", "in_url", "quoted", "assigned", "keyed", "in_address", "distinct_share", "neighbours", "strongest_neighbour"]
#: Hashed places of neighbouring words, and how many findings a word needs to count about half.
PLACES, RARE = 4096, 10.0
_SPLIT = re.compile(r"[A-Za-z0-9]+")


def corpus_words(docs: DataFrame) -> frozenset[str]:
    """The words that most documents write, ``WORDS`` at most."""

    def counted(batches):
        for part in slices(batches):
            codes, starts, distinct = coded_words(part["text"].to_pylist())
            doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            times = np.bincount(np.unique(doc * max(1, len(distinct)) + codes) % max(1, len(distinct)), minlength=len(distinct)) if len(codes) else []
            found: dict[str, int] = {}
            for word, n in zip(distinct, times, strict=True):
                word = word.strip(string.punctuation).lower()
                if WORD_LENGTHS[0] <= len(word) <= WORD_LENGTHS[1] and word.isalpha():
                    found[word] = found.get(word, 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "docs"])

    often = only(docs, "text").mapInArrow(counted, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    return frozenset(r["word"] for r in often.orderBy(F.desc("docs"), "word").limit(WORDS).select("word").collect())


def covered(low: str, dictionary: frozenset[str]) -> int:
    """Characters that words of the dictionary cover, the longest from each place on."""
    at = total = 0
    while at <= len(low) - WORD_LENGTHS[0]:
        n = next((n for n in range(min(WORD_LENGTHS[1], len(low) - at), WORD_LENGTHS[0] - 1, -1) if low[at : at + n] in dictionary), 0)
        total, at = total + n, at + max(1, n)
    return total


def features(text: str, start: int, end: int, dictionary: frozenset[str], keyed: bool = False, in_address: bool = False) -> list[float]:
    value, before, after = text[start:end], text[max(0, start - BESIDE) : start], text[end : end + BESIDE]
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value]
    n = len(value)
    pairs = list(zip(kinds, kinds[1:], strict=False))
    counts = np.unique(list(value), return_counts=True)[1] / n
    low = value.lower()
    vowels = [c in "aeiou" for c in low if c.isalpha()]
    return [
        float(n),
        sum(a != b for a, b in pairs) / max(1, n - 1),
        sum({a, b} in ({0, 2}, {1, 2}) for a, b in pairs) / max(1, n - 1),
        sum(a != b for a, b in zip(vowels, vowels[1:], strict=False)) / max(1, len(vowels) - 1),
        float(-(counts * np.log2(counts)).sum()),
        kinds.count(2) / n,
        kinds.count(1) / n,
        kinds.count(3) / n,
        float(all(c in "0123456789abcdef" for c in low)),
        covered(low, dictionary) / n,
        float(value.count("/")),
        float(before[-1:] in ("/", "\\", ".") and bool(before) or after[:1] in ("/", "\\") and bool(after)),
        float("://" in before.split(" ")[-1] or "www." in before.split(" ")[-1]),
        float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before) and bool(after)),
        float(re.search(r"[=:]\s*[\"'`]?$", before) is not None),
        float(keyed),
        float(in_address),
        len(counts) / n,
    ]


def beside(text: str, start: int, end: int) -> list[str]:
    """The three words before a value and the one behind it, each once."""
    before, after = text[max(0, start - BESIDE) : start], text[end : end + BESIDE]
    return list(dict.fromkeys(w.lower() for w in (*_SPLIT.findall(before)[-3:], *_SPLIT.findall(after)[:1])))


def hashed(lists: list[list[str]]) -> list[np.ndarray]:
    """The place of each word of each list."""
    places = (word_hashes([w for x in lists for w in x]) % np.uint64(PLACES)).astype(np.int32)
    return np.split(places, np.cumsum([len(x) for x in lists])[:-1]) if lists else []


def with_neighbours(values: list[list[float]], places: list[np.ndarray], odds: np.ndarray) -> list[list[float]]:
    """Features with what the neighbouring words say together, and the one that says most."""
    out = []
    for v, p in zip(values, places, strict=True):
        o = odds[p]
        out.append([*v, float(o.sum()), float(o[np.abs(o).argmax()]) if len(o) else 0.0])
    return out


def spans(text: str) -> Iterator[tuple[int, int, bool, bool]]:
    """(start, end, after a key word, in an address) of the candidates, in order."""
    found = [(*m.span(1), False, True) for m in ADDRESS.finditer(text)]
    found += [(*m.span(m.lastindex), True, False) for m in KEYED.finditer(text)]
    known = {f[:2] for f in found}
    found += [(*m.span(), False, False) for m in CANDIDATE.finditer(text) if m.span() not in known]
    last = None
    for span in sorted(found):  # of overlapping ones the longest
        if last is None or span[0] >= last[1]:
            if last is not None:
                yield last
            last = span
        elif span[1] - span[0] > last[1] - last[0]:
            last = span
    if last is not None:
        yield last


def findings(text: str | None, dictionary: frozenset[str]) -> Iterator[tuple[int, int, str, list[float], list[str]]]:
    for start, end, keyed, in_address in spans(text or ""):
        yield start, end - start, hashlib.sha256(text[start:end].encode("utf-8", "surrogatepass")).hexdigest(), features(text, start, end, dictionary, keyed, in_address), beside(text, start, end)


def labelled_findings(spark: SparkSession, dictionary: frozenset[str] = frozenset(), count: int = 4000, seed: int = 5) -> DataFrame:
    """``features, beside, label`` (``beside`` has the places of neighbouring words) of findings made by rule: keys, tokens and passwords in their usual places, and what looks like them."""
    rng = random.Random(seed)
    known = sorted(dictionary) or PLAIN
    word = lambda: rng.choice(rng.choice([PLAIN, known]))
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    hexa, wide = "0123456789abcdef", string.ascii_letters + string.digits
    name = lambda: rng.choice(["token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "private_key"])
    value = lambda: rng.choice([lambda: pick(hexa, rng.choice([32, 40, 48, 64])), lambda: pick(wide, rng.randint(20, 60)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(wide, 36), lambda: pick(wide + "+/", 43) + "="])()
    sentence = lambda: " ".join(word() for _ in range(rng.randint(2, 7)))
    syllables = ["tion", "ing", "the", "ent", "er", "an", "eau", "ment", "sch", "ier", "ou", "que", "lich", "and", "es"]
    letters = "etaoinsrhldcumfpgwybvkxjqz"
    invented = lambda: rng.choice([str.lower, str.upper, str.title])("".join(rng.choice([rng.choice(syllables), pick(letters[:12], rng.randint(1, 4))]) for _ in range(rng.randint(6, 14))))
    short = lambda: pick(wide, rng.randint(8, 15))
    signed = lambda: "".join(rng.sample(pick(wide, rng.randint(6, 12)) + pick("!#$%^&*?.~", rng.randint(2, 4)), k=8))
    login = lambda: rng.choice(["password", "passwd", "pwd", "db_password", "secret", "PASSWORD"])
    true = [
        lambda: f'{login()} = "{rng.choice([short, signed])()}"',
        lambda: f"{login()}: {rng.choice([short, signed])()}",
        lambda: f"{rng.choice(['postgres', 'https', 'ftp'])}://{word()}:{rng.choice([short, signed, value])()}@{word()}.example.org/{word()}",
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + pick(wide, 36),
        lambda: f'{name()} = "{value()}"',
        lambda: f"{name().upper()}={value()}",
        lambda: f'"{name()}": "{value()}"',
        lambda: f"Authorization: Bearer {value()}",
        lambda: f"{name()}: {value()}",
    ]
    false = [
        lambda: f'{login()}: {word()}{rng.choice(["_", "-", ""])}{word()}',
        lambda: f'{name()} = "{word()} {word()} {word()}"',
        lambda: f"{login()}={rng.choice(['${', '%', '<your_', 'os.environ['])}{word()}_{word()}{rng.choice(['}', '%', '>', ']'])}",
        lambda: f"{login()}: {rng.choice(['********', '••••••••', 'changeme', 'required', 'undefined', 'example', 'None, optional', 'string; the'])} {word()}",
        lambda: f"{rng.choice(['the key', 'a token', 'my secret'])}: {word()}{rng.choice([',', '.', ''])} {word()} {word()}",
        lambda: f"https://{word()}:{word()}{word()}@example.org",
        lambda: f"commit {pick(hexa, 40)}",
        lambda: f"sha256: {pick(hexa, 64)}",
        lambda: f'id = "{uuid.UUID(int=rng.getrandbits(128))}"',
        lambda: f"https://{word()}.example.com/{'/'.join(word() for _ in range(4))}/{pick(hexa, 20)}",
        lambda: f"/{word()}/{word()}/{word()}_{word()}/{word()}",
        invented,
        invented,
        lambda: f"{invented()}{rng.choice(['!!', '.', ',', '###', ' é'])} {invented()}",
        lambda: f"{invented()} {rng.choice(['=', '|', ':'])} {invented()}",
        lambda: f'{name()} = "your_{word()}_{word()}_here"',
        lambda: f"{name()}: {pick('x*'[:1], 1) * rng.randint(16, 40)}",
        lambda: f"{word()}_{word()}_{word()}_{word()}",
        lambda: "-" * rng.randint(16, 60),
        lambda: pick(string.digits, rng.choice([16, 19])),
        lambda: f"checksum {pick(hexa, 32)}",
        lambda: f'{name()} = "{word()}" {pick(string.digits, 16)}',
        lambda: f'{name()} {pick(string.digits, 16)}',
    ]
    rows = []
    for k in range(count):
        label = k % 2
        text = f"{sentence()} {rng.choice(true if label else false)()} {sentence()}"
        rows += [(f, words, float(label)) for _, _, _, f, words in findings(text, dictionary)]
    values, words, labels = zip(*rows, strict=True)
    made = [(f, p.tolist(), y) for f, p, y in zip(values, hashed(list(words)), labels, strict=True)]
    return spark.createDataFrame(made, "features array<double>, beside array<int>, label double")


@dataclass(frozen=True)
class SecretModel:
    forest: RandomForestClassificationModel
    odds: np.ndarray  # of each place of neighbouring words

    def judge(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``features`` and ``beside``) with ``score``, the probability of a secret."""
        shared = rows.sparkSession.sparkContext.broadcast(self.odds)

        def full(batches):
            for batch in batches:
                values = with_neighbours(batch["features"].to_pylist(), [np.array(p, np.int64) for p in batch["beside"].to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(values, pa.list_(pa.float64()))], names=[*kept, "features"])

        kept = [c for c in rows.columns if c not in ("features", "beside")]
        ready = rows.mapInArrow(full, rows.select(*kept, "features").schema).withColumn("vector", array_to_vector("features"))
        score = F.get(vector_to_array("probability"), 1) if self.forest.numClasses > 1 else F.lit(0.0)
        return self.forest.transform(ready).withColumn("score", F.coalesce(score, F.lit(0.0))).select(*kept, "score")


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> SecretModel:
    """Learn what neighbouring words say and, with that, the forest, from ``features, beside, label``."""
    true = F.col("label") == 1
    total = labelled.agg(F.count_if(true).alias("true"), F.count_if(~true).alias("false")).first()
    odds = np.zeros(PLACES)
    # A row a place at most.
    for r in labelled.select("label", F.explode("beside").alias("place")).groupBy("place").agg(F.count_if(true).alias("true"), F.count_if(~true).alias("false")).collect():
        share = [(r[k] + RARE / 2) / (max(1, total[k]) + RARE) for k in ("true", "false")]
        seen = r["true"] + r["false"]
        odds[r["place"]] = np.log(share[0] / share[1]) * seen / (seen + RARE)
    shared = labelled.sparkSession.sparkContext.broadcast(odds)

    def full(batches):
        for batch in batches:
            values = with_neighbours(batch["features"].to_pylist(), [np.array(p, np.int64) for p in batch["beside"].to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch["label"]], names=["features", "label"])

    rows = labelled.select("features", "beside", "label").mapInArrow(full, "features array<double>, label double").select(array_to_vector("features").alias("vector"), "label")
    return SecretModel(RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, subsamplingRate=0.8, seed=3).fit(rows), odds)


def scan(docs: DataFrame, model: SecretModel, dictionary: frozenset[str] = frozenset(), threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, start, length, value_sha256, score, is_secret`` of every candidate; the dictionary is the one that the model was learned with."""
    known = docs.sparkSession.sparkContext.broadcast(dictionary)  # WORDS at most

    def found(batches):
        dictionary = known.value
        for part in slices(batches):
            rows = [(i, *f) for i, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True) for f in findings(text, dictionary)]
            ids, start, length, digest, values, words = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(digest, pa.string()), pa.array(values, pa.list_(pa.float64())), pa.array(hashed(list(words)), pa.list_(pa.int32()))], ["doc_id", "start", "length", "value_sha256", "features", "beside"])

    rows = only(docs, "doc_id", "text").mapInArrow(found, "doc_id long, start long, length long, value_sha256 string, features array<double>, beside array<int>")
    return model.judge(rows).select("doc_id", "start", "length", "value_sha256", "score", (F.col("score") >= threshold).cast("int").alias("is_secret"))
