"""Packing by vector bin packing with the dot-product heuristic.

Items have a demand in tokens, segments and loss-bearing tokens; a sequence
has a limit in each. A sequence is filled with the item whose demand has the
largest weighted dot product with what is left of the three limits, among
those that still fit; the weights are the mean demands, so the scarcer
limit counts for more. Documents longer than a sequence are cut into full
pieces and a tail.

Pieces are dealt at random into groups of about ``GROUP`` and each group is
packed by one task, so a task's work is bounded and padding doesn't depend on
the size of the input.

The tokenizer file says how texts become ids: byte-level BPE without a
normalizer, whose merges are in the order of their ids. Any other kind of file
raises an error.

Defined cases: a null or empty text is the end token alone; the tokenizer
file's added tokens have their own ids wherever a text holds them; an item that
exceeds a limit raises an error; repeated rows, and rows with a repeated or
null id, are packed as items of their own; items of equal demand are alike, so
which goes first is open; an empty table gives no rows. Documents are read for
doc_id and text alone; ``pack`` carries all columns of its items, but for
``sequence_id`` and ``segment_offset``, which are replaced.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import only, slices, unused, written

LENGTH = 2048
SEGMENTS = 128
GROUP = 8192
END = 1
#: Fixed value: how byte-level BPE of this kind splits text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that is doubled, or neither a space nor a line feed.
ODD_SPACE = r"[ \n][ \n]|[\x00\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def dot_product_packing(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LENGTH)) -> np.ndarray:
    """The sequence of each item, from 0 on. Items of equal demand are alike, so the choice is among distinct demands."""
    room = np.array(limits, np.float64)
    kinds, kind, counts = np.unique(np.column_stack([tokens, np.ones(len(tokens), np.int64), loss]), axis=0, return_inverse=True, return_counts=True)
    if (kinds > room).any():
        raise ValueError("an item exceeds the limits of a sequence")
    demand = kinds / room
    scaled = demand * (counts @ demand / max(1, len(tokens)))
    places: list[list[int]] = [[] for _ in kinds]
    left, bins, todo = room.copy(), 0, len(tokens)
    counts = counts.copy()
    while todo:
        fits = (counts > 0) & (kinds <= left).all(1)
        if not fits.any():
            left, bins = room.copy(), bins + 1
            continue
        best = int(np.where(fits, scaled @ (left / room), -1.0).argmax())
        places[best].append(bins)
        counts[best] -= 1
        left -= kinds[best]
        todo -= 1
    out, order = np.empty(len(tokens), np.int64), np.argsort(kind, kind="stable")
    out[order] = np.concatenate([np.asarray(p, np.int64) for p in places]) if len(tokens) else 0
    return out


def pack(items: DataFrame, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``items`` (with ``tokens`` and ``loss_tokens``) with ``sequence_id`` and ``segment_offset`` (tokens before it there).

    The rows are written once, so that dealing them into groups is stable when a task runs again.
    """
    items = items.drop("sequence_id", "segment_offset")
    name = unused(items, "group")
    # The row's number is written with it, so that it stays what it is.
    rows = written(items.withColumn(name, F.xxhash64(F.monotonically_increasing_id())))
    groups = max(1, -(-rows.count() // group))
    dealt = rows.withColumn(name, F.pmod(F.col(f"`{name}`"), F.lit(groups)))
    rows = rows.drop(name)
    schema = rows.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("segment_offset")).schema

    def packed(table: pa.Table) -> pa.Table:
        number = table[name][0].as_py()
        tokens = table["tokens"].to_numpy().astype(np.int64)
        bins = dot_product_packing(tokens, table["loss_tokens"].to_numpy().astype(np.int64), (length, segments, loss))
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(tokens[order]) - tokens[order]
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(bins))))
        return table.drop_columns([name]).append_column("sequence_id", pa.array(number + groups * bins)).append_column("segment_offset", pa.array(offset))

    return dealt.groupBy(F.col(f"`{name}`")).applyInArrow(packed, schema)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def stored_tokenizer(tokenizer: str) -> dict:
    """The tokenizer file, if it is of the kind that is encoded here."""
    stored = json.loads(Path(tokenizer).read_text(encoding="utf-8"))
    model, before, added = stored["model"], stored.get("pre_tokenizer") or {}, stored.get("added_tokens") or []
    wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if stored.get("normalizer") or any(before.get(k) != v for k, v in wanted.items()):
        raise ValueError("the tokenizer isn't byte-level without a normalizer and a space put before")
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("the tokenizer isn't plain BPE")
    merged = np.array([model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]])
    if (np.diff(merged) <= 0).any():
        raise ValueError("the tokenizer's merges aren't in the order of their ids")
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("an added token takes in what is beside it")
    return stored


def byte_level(stored: dict) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The byte-level BPE of a ``tokenizers`` file, and the bytes of each id."""
    special = {t["content"] for t in stored.get("added_tokens") or []}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in stored["model"]["vocab"].items() if token not in special}
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    widths[list(ranks.values())] = list(map(len, ranks))
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), widths


def encoder(tokenizer: str) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to all their ids and each text's offsets, with the end id after each.

    A single space always begins a new word of the pattern and a single line
    feed is a word by itself. So texts without other or doubled white space
    are cut there, and each distinct part is encoded once: those with a space
    one after another, those without after a line feed each. The bytes of the
    ids tell where a part ends. Other texts are encoded as they are. Added
    tokens are found in a text before anything else, the longest first: such a
    text is cut there, and they get their own ids.
    """
    stored = stored_tokenizer(tokenizer)
    model, widths = byte_level(stored)
    own_ids = {t["content"]: t["id"] for t in sorted(stored.get("added_tokens") or [], key=lambda t: -len(t["content"]))}
    marks = re.compile(f"({'|'.join(map(re.escape, own_ids))})")
    lone = {p: model.encode_to_numpy(p) for p in ("\n", " ")}
    none = np.zeros(0, np.uint32)

    def alone(text: str) -> list[np.ndarray]:
        parts = marks.split(text) if own_ids else [text]
        return [np.array([own_ids[p]], np.uint32) if k % 2 else model.encode_to_numpy(p) for k, p in enumerate(parts)]

    def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        given = pc.fill_null(pa.array(texts, pa.large_string()), "")
        odd = pc.match_substring_regex(given, ODD_SPACE)
        for content in own_ids:
            odd = pc.or_(odd, pc.match_substring(given, content))
        plain = pc.if_else(odd, "", given)
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0"), "\0")
        parts, ends = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
        distinct = parts.dictionary
        size = pc.binary_length(distinct).to_numpy().astype(np.int64)
        space, feed = (pc.starts_with(distinct, c).to_numpy(zero_copy_only=False) for c in (" ", "\n"))
        spaced, bare = np.flatnonzero(space & (size > 1)), np.flatnonzero(~space & ~feed & (size > 0))
        ids = model.encode_to_numpy("".join([*distinct.take(pa.array(spaced)).to_pylist(), *("\n" + p for p in distinct.take(pa.array(bare)).to_pylist())]))
        order = np.concatenate([spaced, bare])
        long = size[order] + (np.arange(len(order)) >= len(spaced))
        stop = np.searchsorted(np.cumsum(widths[ids]), np.cumsum(long)) + 1
        begin = np.concatenate([[0], stop]).astype(np.int64)[: len(order)]
        begin[len(spaced) :] += 1  # past the line feed
        begins, number = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        begins[order], number[order] = begin, stop - begin
        flat = [ids]
        for own, here in ((lone["\n"], feed), (lone[" "], space & (size == 1))):
            begins[here], number[here] = sum(map(len, flat)), len(own)
            flat.append(own)
        ids, codes = np.concatenate(flat), parts.indices.to_numpy()
        count = number[codes]
        stops = np.concatenate([[0], np.cumsum(count)])
        every = ids[np.repeat(begins[codes] - stops[:-1], count) + np.arange(stops[-1])]
        out, last = [], np.array([END], np.uint32)
        for k, (text, o) in enumerate(zip(texts, odd.to_pylist(), strict=True)):
            out += [np.concatenate(alone(text)) if o else every[stops[ends[k]] : stops[ends[k + 1]]], last]
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return np.concatenate([none, *out]), np.concatenate([[0], np.cumsum(lengths)[1::2]])

    return encode


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """``doc_id, start, tokens, loss_tokens, ids_crc32, doc_tokens`` of every piece: full ones, then the tail."""

    def cut(batches):
        encode = encoder(tokenizer)
        for part in slices(batches, most=4 << 20):
            ids, starts = encode(part["text"].to_pylist())
            number = np.diff(starts)
            parts = -(-number // length)
            doc = np.repeat(np.arange(len(number)), parts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
            size = np.minimum(length, number[doc] - start)
            raw = memoryview(ids.astype("<u4").tobytes())
            at = (starts[doc] + start) * 4
            crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), (size * 4).tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].take(pa.array(doc)), "start": start, "tokens": size, "loss_tokens": size, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": number[doc]})

    return only(docs, "doc_id", "text").mapInArrow(cut, "doc_id long, start long, tokens long, loss_tokens long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """All pieces of all documents with their sequence; every token of a document bears loss."""
    packed = pack(pieces(docs, tokenizer, length), length=length, loss=length)
    return packed.select("doc_id", "start", F.col("tokens").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", F.col("segment_offset").alias("offset"))
