"""Alignment of two tokenizers' ids over the same bytes, and how often ids are linked.

A text's ids by a byte-level tokenizer (A) and by a piece model (B, which puts
a space before the text) cover the same bytes: a space and the text. Offsets at
which an id of either ends are common cuts; between two cuts lies a group. Ids
of A and B that end together are a link; how often a pair of ids is linked is
counted over the corpus, and each text's links are held against those counts.

All of a slice of texts is done at once: ends by cumulative sums, cuts as the
intersection of the ends, groups by binary search among the cuts, links by
repeating each cut's ids. Counts are summed in each task, then by pair and a
salt, then by pair. Of two ids that end together one is the other's last bytes,
so there are no more pairs than the two vocabularies' bytes together: that
bounds the table of counts, which is checked and broadcast. Links are written
once to shared storage, so that texts are encoded once.

Defined cases: a text that is null or empty, or whose joined ids of A or B
aren't a space and the text (a normalised or unknown character, or a character
that B uses for a space), has no ids, groups or links. Special tokens in a text
are plain text. Repeated rows and null ids are rows like others, and all count.
An empty table gives no rows. ``align`` carries the caller's columns, but for
those that it adds, which are replaced; texts are whole, of any length.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm import bytepair
from treeline.llm.common import only, slices, written

#: Fixed value: what a piece model writes for a space.
SPACE_MARK = "▁"
#: Bytes of text that are aligned at once.
SLICE = 1 << 19
SALTS = 16
ADDED = ("a_ids", "a_groups", "b_ids", "b_groups", "a_linked", "b_linked")


class Pieces:
    """Texts to a piece model's ids, a distinct word at a time.

    No piece of such a model holds a space behind another character (checked), so a merge never reaches over the
    start of a word: a run of spaces and what follows it up to the next space is encoded by itself, once, and
    remembered. The model puts a space before what it is given, so a word's first space is left to it. A text that
    holds the model's mark for a space doesn't make up its text again; only its ids may differ from the model's own.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(SPACE_MARK, " ").encode() for k, p in enumerate(names)]
        probe = ["a  b", " a", "a ", "\t", "\u00a0", "ﬁ", "½"]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in names) or any(b"".join(self.bytes[i] for i in self.model.encode(t)) != (" " + t).encode() for t in probe):
            raise ValueError("the piece model changes texts, or its pieces reach over spaces")
        self.space = self.model.encode("a ")[len(self.model.encode("a")) :]
        self.widths = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.same = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts (each with a space before it, or empty) in a row, where each text's start, and whether they make up the text."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        data, first = bytepair.bytes_of(texts), np.cumsum(size) - size
        space = np.frombuffer(data, np.uint8) == ord(" ")
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[first[size > 0]] = True
        begin = np.flatnonzero(begins)
        bounds = np.append(begin, len(space)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), data]).dictionary_encode()
        listed = words.dictionary.to_pylist()
        slot = np.fromiter(map(self.known.get, listed, itertools.repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(slot < 0)
        if len(new):
            made = [listed[k] for k in new]
            ids = self.model.encode([w[1:].decode() for w in made], num_threads=1)
            # The model gives nothing for a text of nothing but the space that it puts there itself.
            ids = [self.space if w == b" " else x for x, w in zip(ids, made, strict=True)]
            same = np.fromiter((b"".join([self.bytes[i] for i in x]) == w for x, w in zip(ids, made, strict=True)), bool, len(made))
            slot[new] = len(self.known) + np.arange(len(new))
            self.known.update(zip(made, slot[new].tolist(), strict=True))
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(count.sum()))])
            self.starts, self.same = np.concatenate([self.starts, self.starts[-1] + np.cumsum(count)]), np.concatenate([self.same, same])
        slot = slot[words.indices.to_numpy()]
        ids, at = bytepair.gathered(self.flat, self.starts[slot], self.starts[slot + 1] - self.starts[slot])
        of_text = np.searchsorted(begin, np.append(first, len(space)))
        wrong = np.concatenate([[0], np.cumsum(~self.same[slot])])[of_text]
        if len(self.known) > bytepair.CACHE or len(self.flat) > 8 * bytepair.CACHE:
            self._forget()
        return ids, at[of_text], wrong[1:] == wrong[:-1]


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> Pieces:
    """The piece model of a worker, which lives through many tasks."""
    return Pieces(path)


@dataclass
class Side:
    """One tokenizer's ids of all texts in a row, where each text's start, the byte at which each ends (from its text's start), its group."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    groups: np.ndarray | None = None


@dataclass
class Aligned:
    a: Side
    b: Side
    groups: np.ndarray  # where each text's groups start
    links: np.ndarray  # where each text's links start
    linked: tuple[np.ndarray, np.ndarray]  # places in a.ids and b.ids


def both(texts: pa.Array, a_path: str, b_path: str) -> tuple[Side, Side]:
    """Ids of the texts; none for those whose ids don't make up a space and the text."""
    given = pc.fill_null(texts.cast(pa.large_string()), "")
    full = pc.not_equal(given, "")
    spaced = pc.if_else(full, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), given, pa.scalar("", pa.large_string())), "")
    ids, ends, starts = bytepair.encoder(a_path)(spaced)
    a = Side(ids, starts, ends.astype(np.int64))
    # A's ids always make up their text: they are made from its bytes.
    model = piece_model(b_path)
    ids, starts, same = model(spaced)
    total = np.concatenate([[0], np.cumsum(model.widths[ids])])
    b = Side(ids, starts, total[1:] - np.repeat(total[starts[:-1]], np.diff(starts)))
    for side in () if same.all() else (a, b):
        number = np.diff(side.starts)
        keep = np.repeat(same, number)
        side.ids, side.ends, side.starts = side.ids[keep], side.ends[keep], np.concatenate([[0], np.cumsum(np.where(same, number, 0))])
    return a, b


def align_sides(a: Side, b: Side) -> Aligned:
    """Groups and links of all texts at once; each text has a stretch of the number line to itself."""
    texts = len(a.starts) - 1
    longest = np.zeros(texts, np.int64)
    for side in (a, b):
        has = np.diff(side.starts) > 0
        longest[has] = np.maximum(longest[has], side.ends[side.starts[1:][has] - 1])
    base = np.cumsum(longest + 2) - (longest + 2)
    ends = [side.ends + np.repeat(base, np.diff(side.starts)) for side in (a, b)]
    cuts = np.intersect1d(*[e[np.diff(e, prepend=-1) > 0] for e in ends], assume_unique=True)
    groups = np.searchsorted(cuts, np.concatenate([base, [np.iinfo(np.int64).max]]))
    for side, end in zip((a, b), ends, strict=True):
        side.groups = np.searchsorted(cuts, end) - np.repeat(groups[:-1], np.diff(side.starts))
    first = [np.searchsorted(end, cuts) for end in ends]
    number = [np.searchsorted(end, cuts, "right") - f for end, f in zip(ends, first, strict=True)]
    each = number[0] * number[1]
    at = np.concatenate([[0], np.cumsum(each)])
    cut = np.repeat(np.arange(len(cuts)), each)
    inside = np.arange(at[-1]) - at[cut]
    linked = (first[0][cut] + inside // number[1][cut], first[1][cut] + inside % number[1][cut])
    return Aligned(a, b, groups, at[groups], linked)


@functools.lru_cache(maxsize=8)
def decimals(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below a limit as decimal signs, with zeros before them and a place behind them, and how many each has."""
    text = [str(k) for k in range(limit)]
    most = len(text[-1])
    signs = np.frombuffer("".join(f"{t:\0>{most}}\0" for t in text).encode(), np.uint8).reshape(limit, most + 1)
    return signs, np.fromiter(map(len, text), np.int64, limit)


def described(found: Aligned) -> list[str]:
    """The SHA-256 of each text's groups written as ``a1,a2|b1;a3|b2,b3``; empty for a text without ids."""
    a, b, texts = found.a, found.b, len(found.groups) - 1
    owner = [np.repeat(found.groups[:-1], np.diff(side.starts)) + side.groups for side in (a, b)]  # group over all texts
    number = int(found.groups[-1])
    counts = [np.bincount(o, minlength=number) for o in owner]
    before = [np.cumsum(c) - c for c in counts]
    place = (np.arange(len(a.ids)) + before[1][owner[0]], np.arange(len(b.ids)) + (before[0] + counts[0])[owner[1]])
    ids, sign = np.empty(len(a.ids) + len(b.ids), np.int32), np.full(len(a.ids) + len(b.ids), ord(","), np.uint8)
    ids[place[0]], ids[place[1]] = a.ids, b.ids
    both_ends = np.cumsum(counts[0] + counts[1])
    sign[before[1] + before[0] + counts[0] - 1] = ord("|")
    sign[both_ends - 1] = ord(";")
    table, widths = decimals(1 << int(ids.max(initial=0)).bit_length())
    letters, width = table[ids], widths[ids]
    letters[:, -1] = sign
    raw = memoryview(letters[letters > 0].tobytes())
    total = np.concatenate([[0], np.cumsum(width + 1)])
    # A text's ids of both sides lie together; its last sign isn't written.
    bounds = total[np.concatenate([[0], both_ends])[found.groups]].tolist()
    return [hashlib.sha256(raw[bounds[k] : bounds[k + 1] - 1]).hexdigest() if bounds[k + 1] > bounds[k] else "" for k in range(texts)]


def parts(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    for part in slices(batches, most=SLICE):
        yield part, align_sides(*both(part["text"], a_path, b_path))


def nested(starts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """All columns of ``docs`` with the ids and groups of both sides and the ids of each link, as arrays."""
    docs = docs.drop(*ADDED)
    schema = docs.select("*", *[F.array(F.lit(0)).alias(c) for c in ADDED]).schema

    def aligned(batches):
        for part, x in parts(batches, a_path, b_path):
            made = [nested(s, v) for side in (x.a, x.b) for s, v in ((side.starts, side.ids), (side.starts, side.groups))]
            made += [nested(x.links, side.ids[at]) for side, at in zip((x.a, x.b), x.linked, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=schema.names)

    return docs.mapInArrow(aligned, schema)


def linked_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups_sha256`` and the ids of each link, ``a_linked`` and ``b_linked``; written once."""

    def linked(batches):
        for part, x in parts(batches, a_path, b_path):
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "n_a": np.diff(x.a.starts), "n_b": np.diff(x.b.starts), "n_groups": np.diff(x.groups), "groups_sha256": pa.array(described(x), pa.string())} | {name: nested(x.links, side.ids[at]) for name, side, at in zip(("a_linked", "b_linked"), (x.a, x.b), x.linked, strict=True)})

    rows = only(docs, "doc_id", "text")
    schema = rows.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups")], F.lit("").alias("groups_sha256"), *[F.array(F.lit(0)).alias(c) for c in ("a_linked", "b_linked")]).schema
    return written(rows.mapInArrow(linked, schema))


def pair_counts(linked: DataFrame) -> DataFrame:
    """``a, b, links``: how many links of the corpus hold each pair of ids."""

    def counted(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in bytepair.run_in_batches(batch, "a_linked"):
                a, b = (bytepair.lists(part[c])[0].astype(np.int64) for c in ("a_linked", "b_linked"))
                own, n = np.unique(a << 32 | b, return_counts=True)
                keys, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"a": (keys >> 32).astype(np.int32), "b": (keys & 0xFFFFFFFF).astype(np.int32), "links": counts})

    by_task = linked.select("a_linked", "b_linked").mapInArrow(counted, "a int, b int, links long")
    salted = by_task.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return salted.groupBy("a", "b", "salt").agg(F.sum("links").alias("links")).groupBy("a", "b").agg(F.sum("links").alias("links"))


def judged(linked: DataFrame, counts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``linked`` with ``n_links``, ``n_best`` (links as frequent as any of their B id) and ``count_sum`` in place of the links' ids."""
    most = counts.groupBy(F.col("b").alias("of")).agg(F.max("links").alias("most"))
    table = counts.join(most, counts["b"] == most["of"]).select("a", "b", "links", (F.col("links") == F.col("most")).alias("best")).toArrow()
    bound = len(bytepair.of_tokenizer(a_path).bytes_of[0]) + int(piece_model(b_path).widths.sum())
    if table.num_rows > bound:
        raise ValueError("more pairs than the vocabularies have bytes")
    keys = table["a"].to_numpy().astype(np.int64) << 32 | table["b"].to_numpy()
    order = np.argsort(keys)
    shared = linked.sparkSession.sparkContext.broadcast((keys[order], table["links"].to_numpy()[order], table["best"].to_numpy()[order]))
    kept = [c for c in linked.columns if c not in ("a_linked", "b_linked")]
    schema = linked.select(*kept, *[F.lit(0).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]).schema

    def held(batches):
        known, links, best = shared.value
        for batch in batches:
            for part in bytepair.run_in_batches(batch, "a_linked"):
                a, starts = bytepair.lists(part["a_linked"])
                at = np.searchsorted(known, a.astype(np.int64) << 32 | bytepair.lists(part["b_linked"])[0])
                sums = [np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (best, links)]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in kept], pa.array(np.diff(starts)), *[pa.array(s[starts[1:]] - s[starts[:-1]]) for s in sums]], names=schema.names)

    return linked.mapInArrow(held, schema)


def align_corpus(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row a document: how many ids, groups and links it has, its groups' digest, and what its links count in the whole corpus."""
    linked = linked_documents(docs, a_path, b_path)
    counts = written(pair_counts(linked))
    return judged(linked, counts, a_path, b_path)
