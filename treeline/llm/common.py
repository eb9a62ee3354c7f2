"""What the operators of this subpackage share: shared storage, folds, batches, words, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.storage import shared_dir, written  # noqa: F401

#: Bytes of text that one step of a Python worker holds.
SLICE_BYTES = 4 << 20
#: Arrays from this size on go back to the system when they are freed; by itself the C library keeps what was once used, and a worker lives through many tasks.
LARGE_ARRAY, _MMAP_THRESHOLD = 4 << 20, -3
if hasattr(_libc := ctypes.CDLL(None), "mallopt"):
    _libc.mallopt(_MMAP_THRESHOLD, LARGE_ARRAY)


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo the number of folds; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(folds)), F.lit(0))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so further columns of the caller can't clash with those made here."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text; one longer text is a slice by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[text].cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        part = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))[:-1]]) // most
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
        del batch
        pa.default_memory_pool().release_unused()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each text starts (one more entry than texts)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def coded_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The whitespace-separated words of all texts as places in a list of distinct words; each text's offsets; that list."""
    lists = pc.utf8_split_whitespace(pc.fill_null(pa.array(texts, pa.large_string()), ""))
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy()]
    words = flat.filter(pa.array(full)).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), starts, words.dictionary.to_pylist()


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, from their code points alone, so equal on every executor and in every run."""
    if not words:
        return np.zeros(0, np.uint64)
    flat, starts = codepoints(words)
    length = np.diff(starts)
    at = np.arange(len(flat), dtype=np.uint64) - np.repeat(starts[:-1], length).astype(np.uint64)
    terms = mix(flat.astype(np.uint64) + (at << np.uint64(32)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return mix(total[starts[1:]] - total[starts[:-1]] + length.astype(np.uint64))


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments; empty segments give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` as ``(id, component)``; the component is its least id.

    Every round points each vertex at its least neighbour, follows those pointers
    twice, and contracts the edges; all of it by grouping and joining, with each
    round written to shared storage. Vertices without an edge are not returned.
    """
    spark = edges.sparkSession
    edges = written(edges.select("u", "v").where("u <> v").distinct())
    maps: list[DataFrame] = []
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("to")))
        for _ in range(2):
            ahead = least.select(F.col("id").alias("to"), F.col("to").alias("next"))
            least = written(least.join(ahead, "to").select("id", F.col("next").alias("to")))
        maps.append(least)
        for end in ("u", "v"):
            edges = edges.join(least.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("to", end)
        edges = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return spark.createDataFrame([], "id long, component long")
    out = maps.pop().select("id", F.col("to").alias("component"))
    while maps:
        up = out.withColumnRenamed("id", "to")
        out = written(maps.pop().join(up, "to", "left").select("id", F.coalesce("component", "to").alias("component")))
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by integer keys as tables of whole groups, each with the first row of every group and its end."""
    kept: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, table.num_rows - 1), bool)
        for k in keys:
            x = table[k].to_numpy()
            new |= x[1:] != x[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1]) if table.num_rows else np.zeros(0, np.int64)

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        table = pa.Table.from_batches(kept)
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at
            kept = table.slice(at[-1]).to_batches()
    if kept:
        table = pa.Table.from_batches(kept)
        yield table, np.append(starts(table), table.num_rows)


def shingle_hashes(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``width`` words in order, and each text's offsets.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    codes, starts, distinct = coded_words(texts)
    hashes = word_hashes(distinct)[codes]
    number = np.diff(starts)
    shingles = np.where(number > 0, np.maximum(1, number - width + 1), 0)
    out_starts = np.concatenate([[0], np.cumsum(shingles)])
    first = np.repeat(starts[:-1] - out_starts[:-1], shingles) + np.arange(out_starts[-1])
    last = np.repeat(starts[1:], shingles)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    total = np.zeros(len(first), np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + np.where(first + k < last, padded[first + k], np.uint64(k + 1))
    return mix(total), out_starts
