"""Byte-level BPE encoding and decoding.

Texts are cut into words without a regular expression: each code point has
one of four classes (letter, number, white space, other), a look at its
neighbours turns it into a symbol of a small automaton, and the automaton runs
over all texts of a slice at once as an associative scan. For that, symbols
stand for transition functions; the functions that can arise form a small
closed set, so composing two of them is one look-up in a table, done for many
blocks side by side. The words of a slice are told apart by Arrow, and each
word not met before is merged: all such words together, a pair of each a round.
What was merged is kept for later words, up to ``CACHE`` of them.

A vocabulary is a file of ranks (a word that is an entry itself is one id, any
two neighbours whose bytes make up an entry may merge, the least rank first) or
of a byte-level tokenizer (pairs of its list alone merge, in the list's order).
Ids come with the byte at which each ends, by which they are decoded again.

One pass over whole texts; no row moves. Defined cases: a null or empty text
has no ids and decodes to nothing; any code point may occur, and every byte of
a text is in exactly one id; a word of any length is merged whole; repeated
rows and null ids are rows like others; an empty table gives no rows. Special
tokens are plain text here. Columns of the caller are kept, but for ``ids``,
``ends`` and ``decoded``, which are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import slices
from treeline.llm.packing import byte_letters, stored_tokenizer

OTHER, LETTER, NUMBER, SPACE = range(4)
#: White space as Unicode has it.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What Unicode 16 added to letters and numbers, first and last; Python's own tables may be older.
LATER_LETTERS = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
LATER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Letters that an apostrophe at the start of a word takes with it.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")

#: Where the automaton is: between words, in a run of one class, behind a blank that opens a word, or one or two letters before the end of an apostrophe's word.
BETWEEN, LETTERS, NUMBERS, OTHERS, SPACES, OPENED, ONE_MORE, TWO_MORE = range(8)
#: What it reads: a class, an apostrophe with one or two letters to take, or the last white space before a word (a blank joins that word).
MARK1, MARK2, BLANK, LAST = range(4, 8)
SYMBOLS = 8
#: Blocks that the scan runs side by side have this many symbols.
BLOCK = 64
#: Words that a worker remembers, and the bytes up to which words are merged side by side.
CACHE, WIDTHS = 1 << 17, (8, 16, 32, 64)
NONE = np.int32(2**31 - 1)


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a word starts with it. An apostrophe that takes letters is always followed by them."""
    if symbol == LETTER and state in (ONE_MORE, TWO_MORE):
        return (BETWEEN if state == ONE_MORE else ONE_MORE), False
    if symbol in (SPACE, BLANK, LAST):
        return {SPACE: SPACES, BLANK: OPENED, LAST: BETWEEN}[symbol], symbol != SPACE or state != SPACES
    run = {LETTER: LETTERS, NUMBER: NUMBERS}.get(symbol, OTHERS)
    if state in (OPENED, run):
        return run, False
    return {MARK1: ONE_MORE, MARK2: TWO_MORE}.get(symbol, run), True


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The functions of symbols, the table that composes two functions, each function's states, and which steps start a word.

    Symbols from ``SYMBOLS`` on are the same ones at the start of a text: their functions forget the state.
    """
    states = range(8)
    of_symbol = [tuple(step(s, x)[0] for s in states) for x in range(SYMBOLS)]
    of_symbol += [(f[BETWEEN],) * 8 for f in of_symbol]
    known = {f: k for k, f in enumerate(dict.fromkeys([tuple(states), *of_symbol]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in of_symbol:
            if (both := tuple(g[s] for s in f)) not in known:
                known[both] = len(known)
                todo.append(both)
    functions = np.array(list(known), np.uint8)
    index = {bytes(f): k for k, f in enumerate(functions)}
    compose = np.array([[index[g[f].tobytes()] for g in functions] for f in functions], np.uint8)
    starts = np.array([[step(s, x)[1] for x in range(SYMBOLS)] + [True] * SYMBOLS for s in states])
    return np.array([known[f] for f in of_symbol], np.uint8), compose, functions, starts


def states_after(functions: np.ndarray) -> np.ndarray:
    """The state after each of the functions in order, from ``BETWEEN`` on."""
    _, compose, images, _ = automaton()
    number, table = len(compose), compose.ravel()
    rows = -(-len(functions) // BLOCK)
    padded = np.zeros(rows * BLOCK, np.uint8)  # function 0 changes nothing
    padded[: len(functions)] = functions
    scanned = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    for k in range(1, BLOCK):
        scanned[k] = table[scanned[k - 1].astype(np.uint16) * number + scanned[k]]
    # State before each block: the same scan over what whole blocks do, or one after another where they are few.
    before = np.zeros(rows, np.uint8)
    if rows > BLOCK:
        before[1:] = states_after(scanned[-1])[:-1]
    else:
        for k in range(1, rows):
            before[k] = images[scanned[-1, k - 1], before[k - 1]]
    return images.ravel()[scanned.astype(np.uint16) * 8 + before].T.reshape(-1)[: len(functions)]


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, ranges in ((LETTER, LATER_LETTERS), (NUMBER, LATER_NUMBERS)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[list(WHITE_SPACE)] = SPACE
    return out


def word_starts(codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Which code points start a word; ``texts`` has the places where texts that aren't empty start."""
    if not len(codes):
        return np.zeros(0, bool)
    kind = classes()[codes]
    final = np.zeros(len(codes) + 2, bool)  # a text ends with it
    final[texts[1:] - 1] = True
    final[len(codes) - 1 :] = True
    symbol = kind.copy()
    space = kind == SPACE
    last = space[:-1] & ~space[1:] & ~final[: len(codes) - 1]
    symbol[:-1][last] = np.where(codes[:-1][last] == ord(" "), BLANK, LAST)
    at = np.flatnonzero(codes == ord("'"))
    padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
    one = np.where(final[at], 0, padded[at + 1])
    two = np.where(final[at] | final[at + 1], 0, padded[at + 2])
    short = np.isin(one, [ord(c) for c in SHORT_ENDINGS])
    long = np.logical_or.reduce([(one == ord(e[0])) & (two == ord(e[1])) for e in LONG_ENDINGS])
    symbol[at[short]], symbol[at[long]] = MARK1, MARK2
    symbol[texts] += SYMBOLS
    of_symbol, _, _, starts = automaton()
    before = np.concatenate([np.zeros(1, np.uint8), states_after(of_symbol[symbol])[:-1]])
    return starts.ravel()[before.astype(np.uint16) * (2 * SYMBOLS) + symbol]


class PairTable:
    """A hash table from two neighbouring ids to the id that they merge to, probed for whole arrays at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, ids: int):
        self.ids = ids + 1  # one more that merges with nothing, to fill up rows
        self.bits = max(10, int(4 * len(merged)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE)
        keys = left.astype(np.int64) * self.ids + right
        todo, at = np.arange(len(keys)), self._place(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[at] == -1)
            slots, first = np.unique(at[free], return_index=True)
            self.keys[slots], self.values[slots] = keys[todo[free[first]]], merged[todo[free[first]]]
            rest = np.ones(len(todo), bool)
            rest[free[first]] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) * self.ids + right).ravel()
        at = self._place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        again = np.flatnonzero((found != keys) & (found != -1))
        while len(again):
            at[again] = (at[again] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[again]]
            hit = found == keys[again]
            out[again[hit]] = self.values[at[again[hit]]]
            again = again[~hit & (found != -1)]
        return out.reshape(left.shape)

    @functools.cached_property
    def by_pair(self) -> dict[int, int]:
        full = self.keys != -1
        return dict(zip(self.keys[full].tolist(), self.values[full].tolist(), strict=True))


@dataclass(frozen=True)
class Vocabulary:
    """Ids with their bytes, the pairs that merge (the least id first), and the words that are an id by themselves."""

    entries: dict[bytes, int]
    pairs: PairTable
    whole: bool

    @functools.cached_property
    def bytes_of(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids' bytes in a row, and where each id's start (one more than ids); ids that aren't used have none."""
        by_id = [b""] * (max(self.entries.values()) + 1)
        for b, k in self.entries.items():
            by_id[k] = b
        return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, by_id)))])

    @functools.cached_property
    def of_byte(self) -> np.ndarray:
        return np.array([self.entries[bytes([b])] for b in range(256)], np.int32)


@functools.cache
def of_ranks(path: str) -> Vocabulary:
    """A file with a line for each entry: its bytes in base 64 and its rank."""
    entries = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    splits = [(entries[e[:k]], entries[e[k:]], i) for e, i in entries.items() for k in range(1, len(e)) if e[:k] in entries and e[k:] in entries]
    left, right, merged = np.array(splits, np.int32).reshape(-1, 3).T
    return Vocabulary(entries, PairTable(left, right, merged, max(entries.values()) + 1), True)


@functools.cache
def of_tokenizer(path: str) -> Vocabulary:
    """A byte-level tokenizer's file; its list of merges must be in the order of their ids (checked)."""
    stored = stored_tokenizer(path)
    letters, special = byte_letters(), {t["content"] for t in stored.get("added_tokens") or []}
    ids = stored["model"]["vocab"]
    entries = {bytes(letters[c] for c in token): i for token, i in ids.items() if token not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in stored["model"]["merges"]]
    left, right, merged = np.array([(ids[a], ids[b], ids[a + b]) for a, b in merges], np.int32).reshape(-1, 3).T
    return Vocabulary(entries, PairTable(left, right, merged, max(entries.values()) + 1), False)


def of_file(path: str) -> Vocabulary:
    return of_tokenizer(path) if path.endswith(".json") else of_ranks(path)


class Merger:
    """Words to ids, with a memory of the words met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        own = self.vocabulary.entries if self.vocabulary.whole else {}
        self.known = {b: k for k, b in enumerate(own)}
        self.flat = np.fromiter(own.values(), np.int32, len(own))
        self.starts = np.arange(len(own) + 1, dtype=np.int64)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and where each word's start (one more than words)."""
        listed = words.to_pylist()
        slot = np.fromiter(map(self.known.get, listed, itertools.repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(slot < 0)
        if len(new):
            ids, starts = self._merged([listed[k] for k in new])
            slot[new] = len(self.known) + np.arange(len(new))
            self.known.update(zip((listed[k] for k in new), slot[new].tolist(), strict=True))
            self.flat, self.starts = np.concatenate([self.flat, ids]), np.concatenate([self.starts, self.starts[-1] + starts[1:]])
        out = gathered(self.flat, self.starts[slot], self.starts[slot + 1] - self.starts[slot])
        if len(self.known) > CACHE or len(self.flat) > 8 * CACHE:
            self._forget()
        return out

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.concatenate([[0], np.cumsum(size)])
        count, parts, rows = np.zeros(len(words), np.int64), [], []
        least = 0
        for width in WIDTHS:
            own = np.flatnonzero((size > least) & (size <= width))
            least = width
            if len(own):
                tokens = np.full((len(own), width + 1), self.vocabulary.pairs.ids - 1, np.int32)
                inside = np.arange(width + 1) < size[own, None]
                tokens[inside] = flat[np.repeat(starts[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(size[own].sum())]
                for done, ids in self._rounds(tokens):
                    real = ids < self.vocabulary.pairs.ids - 1
                    count[own[done]] = real.sum(1)
                    rows.append(own[done])
                    parts.append(ids[real])
        for k in np.flatnonzero(size > least):
            ids = self._long(flat[starts[k] : starts[k + 1]])
            count[k] = len(ids)
            rows.append(np.array([k]))
            parts.append(ids)
        # Parts lie in the order of ``rows``; put them into the order of the words.
        order = np.concatenate([np.zeros(0, np.int64), *rows])
        at = np.zeros(len(words), np.int64)
        at[order] = np.cumsum(count[order]) - count[order]
        return gathered(np.concatenate([np.zeros(0, np.int32), *parts]), at, count)

    def _rounds(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge the first of the least pairs of every row, round by round; rows are given out once nothing merges."""
        pairs = self.vocabulary.pairs
        ranks = pairs(tokens[:, :-1], tokens[:, 1:])
        number = np.arange(len(tokens))
        while len(number):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(at)), at]
            live = best != NONE
            if not live.all():
                yield number[~live], tokens[~live]
                number, tokens, ranks, at, best = number[live], tokens[live], ranks[live], at[live], best[live]
                if not len(number):
                    return
            row, behind = np.arange(len(at)), np.arange(tokens.shape[1] - 1) > at[:, None]
            tokens = np.where(behind, tokens[:, 1:], tokens[:, :-1])
            tokens[row, at] = best
            ranks = np.where(behind[:, :-1] | (np.arange(ranks.shape[1] - 1) == at[:, None]), ranks[:, 1:], ranks[:, :-1])
            inner = at < ranks.shape[1]
            ranks[row[inner], at[inner]] = pairs(best[inner], tokens[row[inner], at[inner] + 1])
            inner = at > 0
            ranks[row[inner], at[inner] - 1] = pairs(tokens[row[inner], at[inner] - 1], best[inner])
            if not ranks.shape[1]:
                yield number, tokens
                return

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long word, by a queue of its pairs."""
        pairs, many = self.vocabulary.pairs.by_pair, self.vocabulary.pairs.ids
        ids, count = ids.tolist(), len(ids)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))

        def pair(k: int) -> tuple[int, int, int, int] | None:
            n = after[k]
            merged = pairs.get(ids[k] * many + ids[n]) if n < count else None
            return None if merged is None else (merged, k, ids[k], ids[n])

        queue = [p for k in range(count) if (p := pair(k))]
        heapq.heapify(queue)
        while queue:
            merged, k, a, b = heapq.heappop(queue)
            if ids[k] != a or after[k] >= count or ids[after[k]] != b:
                continue
            gone = after[k]
            ids[k], ids[gone], after[k] = merged, -1, after[gone]
            if after[k] < count:
                before[after[k]] = k
            for p in (pair(before[k]) if before[k] >= 0 else None, pair(k)):
                if p:
                    heapq.heappush(queue, p)
        return np.array([i for i in ids if i >= 0], np.int32)


def gathered(flat: np.ndarray, starts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` one after another, and where each starts then (one more than runs)."""
    ends = np.concatenate([[0], np.cumsum(count)])
    return flat[np.repeat(starts - ends[:-1], count) + np.arange(ends[-1])], ends


def bytes_of(texts: pa.Array) -> pa.Buffer:
    """The bytes of all texts of a large array without nulls, in a row."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else [0]
    return data.slice(at[0], at[-1] - at[0]) if data else pa.py_buffer(b"")


class Encoder:
    """All texts of an array to their ids at once; kept by a worker between slices."""

    def __init__(self, vocabulary: Vocabulary):
        self.merger = Merger(vocabulary)
        self.widths = np.diff(vocabulary.bytes_of[1])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, the byte of its text at which each ends, and where each text's ids start."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(length) - length
        data = bytes_of(texts)
        codes = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)
        begin = np.flatnonzero(word_starts(codes, first[length > 0]))
        width = 1 + (codes >= 0x80).astype(np.uint8) + (codes >= 0x800) + (codes >= 0x10000)
        offset = (np.cumsum(width, dtype=np.int64) - width)[begin]
        bounds = np.concatenate([offset, [size.sum()]]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), data]).dictionary_encode()
        ids, starts = self.merger(words.dictionary)
        code = words.indices.to_numpy().astype(np.int64)
        ids, at = gathered(ids, starts[code], np.diff(starts)[code])
        of_text = at[np.searchsorted(begin, np.concatenate([first, [len(codes)]]))]
        ends = np.cumsum(self.widths[ids])
        before = np.repeat(np.cumsum(size) - size, np.diff(of_text))
        return ids, (ends - before).astype(np.int32), of_text


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a worker, which lives through many tasks."""
    return Encoder(of_file(path))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """All columns of ``docs`` with the ids of ``text`` and the byte at which each ends."""
    docs = docs.drop("ids", "ends")
    schema = docs.select("*", F.array(F.lit(0)).alias("ids"), F.array(F.lit(0)).alias("ends")).schema

    def encoded(batches):
        for part in slices(batches):
            ids, ends, starts = encoder(vocabulary)(part["text"])
            at = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(at, pa.array(ends, pa.int32()))], names=schema.names)

    return docs.mapInArrow(encoded, schema)


def texts_of(vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, each id's put where the id before it ended; where each text's bytes start."""
    pool, at = vocabulary.bytes_of
    width = np.diff(at)[ids]
    size = np.zeros(len(starts) - 1, np.int64)
    full = np.diff(starts) > 0
    size[full] = ends[starts[1:][full] - 1]
    text = np.concatenate([[0], np.cumsum(size)])
    if (ends.astype(np.int64) + np.repeat(text[:-1], np.diff(starts)) != np.cumsum(width)).any():
        raise ValueError("the ids don't end where they are said to end in this vocabulary")
    return gathered(pool, at[ids], width)[0], text


def run_in_batches(table: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the lists of a column hold about ``most`` values a part; one longer list is a part by itself."""
    sizes = pc.fill_null(pc.list_value_length(table[column]), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    for a, b in itertools.pairwise([*np.flatnonzero(np.diff(part, prepend=-1)), table.num_rows]):
        yield table.slice(a, b - a)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as all values in a row and where each list starts; a null list is empty."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """All columns of ``encoded`` with ``decoded``, the bytes of ``ids``; an id whose bytes don't end at its ``ends`` is an error."""
    encoded = encoded.drop("decoded")
    schema = encoded.select("*", F.lit(b"").alias("decoded")).schema

    def texts(batches):
        known = of_file(vocabulary)
        for batch in batches:
            for part in run_in_batches(batch, "ids"):
                ids, starts = lists(part["ids"])
                flat, at = texts_of(known, ids, lists(part["ends"])[0], starts)
                decoded = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(at), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=schema.names)

    return encoded.mapInArrow(texts, schema)


def digests(coded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: of ids as little-endian 32-bit integers, and of the decoded bytes."""

    def hashed(batches):
        for batch in batches:
            ids, starts = lists(batch["ids"])
            raw, at = memoryview(ids.astype("<u4")).cast("B"), (starts * 4).tolist()
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in itertools.pairwise(at)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_tokens": np.diff(starts), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": batch["decoded_sha256"]})

    rows = coded.select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return rows.mapInArrow(hashed, rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), "decoded_sha256").schema)
