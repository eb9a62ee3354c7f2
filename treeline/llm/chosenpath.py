"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles; two different texts are linked if their
Jaccard similarity is at least ``SIMILARITY``. Equal texts are one member
from the start.

1. Every distinct text gets a min-hash sketch. In each of ``runs()`` runs (a
   number that follows from the target recall) a node chooses one or two of
   the sketch's places, and its members go on to the child of the shingle
   that is sampled there. A pair at the threshold shares one child on average.
2. Nodes with ``SMALL`` members or fewer are compared within one task by their
   sketches. In larger ones, members similar to a leader of the node are linked
   to it; those of ``LEAVES`` or more leave (who is linked to them is similar to
   the leader too), so large groups of near copies end. The others split again.
3. What is similar by sketches makes candidate groups (connected components).
   In each group all shingle sets are compared exactly, larger groups in
   blocks of ``BLOCK`` by ``BLOCK``. Tasks return counts and spanning links,
   never all pairs.

A document's class is the least doc_id that is reachable by links and equal
texts; ``links`` counts the other documents with an equal or linked text.

Defined cases: null texts and texts without words are linked to nothing and
are their own class; texts of fewer than five words have one shingle, all
their words; repeated rows count as documents each; rows that share a doc_id
with different texts are members of their own; a row with a null doc_id is a
member like any other, and only a class in which every id is null has a null
class_id. Two classes can have one class_id where rows share a doc_id, so
``kept`` marks, by row, what to keep of each class. An empty table gives no
rows. Other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import components, mix, only, shingle_hashes, slices, whole_groups, written

SIMILARITY = 0.8
WIDTH = 5
PLACES = 64
SMALL = 1024
BLOCK = 256
DEEPEST = 40
TARGET_RECALL = 0.999
#: Chance that a pair at the threshold stays together in one run down to a few levels.
KEPT = 0.45
#: Share of equal sketch places from which a pair is a candidate; well below the threshold, since sketches err by 0.05.
CANDIDATE = 0.5
LEAVES = 0.7
SECOND = int((1 / SIMILARITY - 1) * 2**32)


def runs(recall: float = TARGET_RECALL, kept: float = KEPT) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - kept))


def sketches(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Min-hash values (32 bits) of each set, ``PLACES`` a row; sets must not be empty."""
    out = np.empty((len(starts) - 1, PLACES), np.uint32)
    rng = np.random.default_rng(11)
    for k in range(PLACES):
        factor = rng.integers(1, 1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        out[:, k] = np.minimum.reduceat((hashes * factor) >> np.uint64(32), starts[:-1])
    return out


def children(paths: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) for the one or two places that each row's node samples."""
    rows, out = [], []
    for n in (1, 2):
        choice = mix(paths, n)
        at = np.arange(len(paths)) if n == 1 else np.flatnonzero((choice & np.uint64(0xFFFFFFFF)) < np.uint64(SECOND))
        place = (choice[at] >> np.uint64(40)) % np.uint64(PLACES)
        rows.append(at)
        out.append(mix(mix(paths[at] + place, 3) ^ sketch[at, place.astype(np.int64)].astype(np.uint64), 4))
    return np.concatenate(rows), np.concatenate(out)


def matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """A column of equally long byte strings as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, key, sketch`` of every row; the sketch is null where the text has no words."""

    def made(batches):
        for part in slices(batches):
            hashes, starts = shingle_hashes(part["text"].to_pylist(), WIDTH)
            some = np.flatnonzero(np.diff(starts))
            found = sketches(hashes, starts[np.append(some, len(starts) - 1)]) if len(some) else np.zeros((0, PLACES), np.uint32)
            stored: list[bytes | None] = [None] * part.num_rows
            for k, x in zip(some.tolist(), found, strict=True):
                stored[k] = x.tobytes()
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "key": part["key"], "sketch": pa.array(stored, pa.binary())})

    return only(docs, "doc_id", "text").select("doc_id", "text", F.md5("text").alias("key")).mapInArrow(made, "doc_id long, key string, sketch binary")


def linked(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Spanning links of each node's members whose sketches are similar."""
    rep, sketch = table["rep"].to_numpy(), matrix(table["sketch"], np.uint16)
    u, v = [], []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        own = sketch[a:b]
        near = (own[:, None] == own[None]).mean(2) >= CANDIDATE if b - a <= 64 else np.stack([(own == x).mean(1) >= CANDIDATE for x in own])
        root = roots(near)
        off = np.flatnonzero(root != np.arange(b - a))
        u.append(rep[a:b][off])
        v.append(rep[a:b][root[off]])
    return pa.RecordBatch.from_pydict({"u": np.concatenate(u), "v": np.concatenate(v)})


def roots(near: np.ndarray) -> np.ndarray:
    """The least member of each row's connected component in a symmetric matrix."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] < 0:
            seen = np.zeros(len(near), bool)
            seen[i] = True
            edge = seen
            while edge.any():
                edge = near[edge].any(0) & ~seen
                seen |= edge
            root[seen] = i
    return root


def candidate_links(reps: DataFrame) -> DataFrame:
    """``u, v`` of texts that are similar by sketches; connected where the whole graph of such pairs is, to the target recall."""
    roots_ = mix(np.arange(runs(), dtype=np.uint64), 21)

    def first(batches):
        for batch in batches:
            sketch = matrix(batch["sketch"], np.uint32) if batch.num_rows else np.zeros((0, PLACES), np.uint32)
            rep = batch["rep"].to_numpy()
            for root in roots_:
                row, path = children(np.full(len(rep), root), sketch)
                yield pa.RecordBatch.from_pydict({"path": path.view(np.int64), "rep": rep[row]})

    def narrow(batches):
        for batch in batches:
            cut = [x.astype(np.uint16).tobytes() for x in matrix(batch["sketch"], np.uint32)] if batch.num_rows else []
            yield pa.RecordBatch.from_pydict({"rep": batch["rep"], "sketch": pa.array(cut, pa.binary())})

    def deeper(batches):
        for batch in batches:
            if batch.num_rows:
                row, path = children(batch["path"].to_numpy().view(np.uint64), matrix(batch["sketch"], np.uint16))
                yield pa.RecordBatch.from_pydict({"path": path.view(np.int64), "rep": batch["rep"].to_numpy()[row]})

    def compared(batches):
        for table, starts in whole_groups(batches, "path"):
            yield linked(table, starts)

    def to_leader(batches):
        for batch in batches:
            if batch.num_rows:
                same = (matrix(batch["sketch"], np.uint16) == matrix(batch["leader_sketch"], np.uint16)).mean(1)
                yield pa.RecordBatch.from_pydict({"path": batch["path"], "rep": batch["rep"], "leader": batch["leader"], "sketch": batch["sketch"], "same": pa.array(same)})

    sketch = written(reps.select("rep", "sketch").mapInArrow(narrow, "rep long, sketch binary"))
    nodes, links = written(reps.select("rep", "sketch").mapInArrow(first, "path long, rep long")), []
    for level in range(1, DEEPEST + 1):
        sizes = nodes.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        shared = written(nodes.join(sizes, "path").join(sketch, "rep").select("path", "rep", "n", "sketch"))
        small, large = shared.where(F.col("n") <= SMALL).drop("n"), shared.where(F.col("n") > SMALL).drop("n")
        links.append(written(small.repartition("path").sortWithinPartitions("path", "rep").mapInArrow(compared, "u long, v long").distinct()))
        if large.isEmpty():
            break
        order = F.xxhash64("path", "rep")
        leaders = large.groupBy("path").agg(F.min(F.struct(order.alias("o"), F.col("rep"))).alias("m")).select("path", F.col("m.rep").alias("leader"))
        leaders = leaders.join(sketch.select(F.col("rep").alias("leader"), F.col("sketch").alias("leader_sketch")), "leader")
        led = written(large.join(leaders, "path").mapInArrow(to_leader, "path long, rep long, leader long, sketch binary, same double"))
        links.append(led.where(F.col("same") >= CANDIDATE).where("rep <> leader").select(F.col("rep").alias("u"), F.col("leader").alias("v")))
        large = led.where(F.col("same") < LEAVES).select("path", "rep", "sketch")
        nodes = written(large.mapInArrow(deeper, "path long, rep long"))
    else:
        raise RuntimeError("a node doesn't get small")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def similar(tokens: list[np.ndarray], others: list[np.ndarray] | None, threshold: float = SIMILARITY) -> np.ndarray:
    """Which sets have at least the threshold's Jaccard similarity, by exact intersections; columns are ``others``, or the same sets."""
    every = tokens + (others or [])
    sizes = np.array([len(t) for t in every])
    flat = np.concatenate(every)
    owner = np.repeat(np.arange(len(every)), sizes)
    _, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    n = len(tokens)
    common = np.zeros((n, len(others) if others is not None else n), np.float32)
    width = max(64, (4 << 20) // len(every))
    for low in range(0, int(code[-1]) + 1, width):
        a, b = np.searchsorted(code, [low, low + width])
        present = np.zeros((len(every), width), np.float32)
        present[owner[a:b], code[a:b] - low] = 1
        common += present[:n] @ (present[n:] if others is not None else present).T
    right = sizes[n:] if others is not None else sizes
    # Counts are whole numbers, so this is exact: threshold * (|a| + |b| - common) <= common.
    return common * (1 + threshold) >= threshold * (sizes[:n, None] + right[None]) - 1e-6


def verified(docs: DataFrame, reps: DataFrame, groups: DataFrame) -> DataFrame:
    """``rep, root, links``: a member's root in its comparison and the documents that it is linked to there (not its own copies)."""
    sized = groups.join(groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = sized.select(F.col("id").alias("rep"), "component", "blocks", "block").join(reps.select("rep", "key", "doc_id", "copies"), "rep")
    texts = only(docs, "doc_id", "text").select("doc_id", F.md5("text").alias("key"), "text")
    own = (members["key"] == texts["key"]) & members["doc_id"].eqNullSafe(texts["doc_id"])
    texts = members.join(texts, own).select("rep", "component", "blocks", "block", "copies", "text")

    def sets(batches):
        for part in slices(batches):
            hashes, starts = shingle_hashes(part["text"].to_pylist(), WIDTH)
            own = [np.unique(hashes[a:b]).astype("<u8").tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({c: part[c] for c in ("rep", "component", "blocks", "block", "copies")} | {"tokens": pa.array(own, pa.binary())})

    rows = texts.mapInArrow(sets, "rep long, component long, blocks int, block int, copies long, tokens binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("*", other).select("rep", "component", "block", "copies", "tokens", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compared(batches):
        for table, starts in whole_groups(batches, "component", "i", "j"):
            out = {"rep": [], "root": [], "links": []}
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                part = table.slice(a, b - a)
                _, once = np.unique(part["rep"].to_numpy(), return_index=True)  # a repeated row is one member
                part = part.take(pa.array(once))
                rep, copies = part["rep"].to_numpy(), part["copies"].to_numpy()
                block, i, j = part["block"].to_numpy(), part["i"][0].as_py(), part["j"][0].as_py()
                tokens = [np.frombuffer(t, "<u8") for t in part["tokens"].to_pylist()]
                if i == j:
                    near = similar(tokens, None)
                    np.fill_diagonal(near, False)
                else:
                    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
                    near = np.zeros((len(rep), len(rep)), bool)
                    if len(left) and len(right):
                        near[np.ix_(left, right)] = similar([tokens[k] for k in left], [tokens[k] for k in right])
                        near |= near.T
                out["rep"].append(rep)
                out["root"].append(rep[roots(near)])
                out["links"].append(near @ copies)
            yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in out.items()})

    return rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "rep").mapInArrow(compared, "rep long, root long, links long")


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, key, class_id, links, kept`` of every row: ``key`` is the text's MD5; ``kept`` is true for one doc_id and key of each class (least doc_id, then key)."""
    every = written(sketched(docs))
    keyed = every.where("sketch IS NOT NULL")
    reps = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()))
    groups = components(candidate_links(reps))
    found = written(verified(docs, reps, groups))
    exact = components(found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classed = reps.select("rep", "key", "doc_id", "copies").join(exact.select(F.col("id").alias("rep"), "component"), "rep", "left").join(counts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key"))
    least = classed.groupBy("component").agg(first.alias("first"))
    by_key = written(classed.join(least, "component").select("key", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("first_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    kept = (F.col("key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    known = keyed.select("doc_id", "key").join(by_key, "key").select("doc_id", "key", "class_id", "links", kept.alias("kept"))
    wordless = every.where("sketch IS NULL").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("kept"))
    return known.unionByName(wordless)
