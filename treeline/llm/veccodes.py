"""Vector code compression: product quantisation in exact integers.

A component x becomes floor(256 x). Vectors are cut into equal parts; for each
part position a codebook of integer entries is learned: it starts as that part
of the vectors with the least ids; each round assigns every part to the nearest
entry (the lower index at a tie) and moves entries to the floor of the mean of
their parts. Entries that no part is nearest to stay.

The codebooks are broadcast (64 entries of a vector's length, whatever the
number of rows). A task works on Arrow batches: distances of all parts to all
entries are |x|^2 - 2 x.c + |c|^2 with int64 matrix products, the first least
one is taken. A task adds up its own sums and counts an entry; those are merged
by a grouped shuffle each round, and only entries come to the driver. Errors by
label are summed before they are joined; the join is a broadcast up to
``BROADCAST_LABELS`` labels and salted beyond, so a hot label is spread.

Defined cases: a vector that is null or has a null or non-finite component is
dropped; of the rest, one that hasn't the length of the vector with the least
id, or whose length is 0 or not a multiple of the parts, keeps its row with null
``code`` and ``error``; null ids come last; vectors of equal ids are ordered by
their integers; repeated rows count as often as they occur; where there are
fewer vectors than entries, the codebook has that many; no vector at all gives
no rows. Integers too large for exact 64-bit distances are an error. Columns of
the caller are carried, but for ``code`` and ``error``, which are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import only, unused, written

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors that are held against the codebooks at once.
STEP = 2048
BROADCAST_LABELS, SALTS = 100_000, 32


@dataclass(frozen=True)
class Codebooks:
    entries: np.ndarray  # part x entry x position, int64

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part (``vectors x part x position``) and its squared distance."""
        codes, least = np.empty(parts.shape[:2], np.int64), np.empty(parts.shape[:2], np.int64)
        for p, book in enumerate(self.entries):
            own = parts[:, p]
            distance = (own * own).sum(1)[:, None] - 2 * (own @ book.T) + (book * book).sum(1)
            codes[:, p] = distance.argmin(1)
            least[:, p] = np.take_along_axis(distance, codes[:, p, None], 1)[:, 0]
        return codes, least

    def sha256(self) -> str:
        """Of all integers by part, entry and position, as decimals between commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(values: np.ndarray, length: int) -> np.ndarray:
    """Components as integers, a row a vector; none so large that a squared distance over the whole length might pass 64 bits."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() > np.sqrt(2.0**61 / max(1, length)):
        raise ValueError("a component is too large for exact 64-bit distances")
    return scaled.astype(np.int64).reshape(-1, length)


def kept(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has only finite components."""
    own = F.col(f"`{column}`")
    return vectors.where(own.isNotNull() & F.coalesce(F.forall(own, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))), F.lit(False)))


def usable(vectors: DataFrame, column: str, length: int) -> DataFrame:
    return vectors.where(F.size(F.col(f"`{column}`")) == length)


def start(vectors: DataFrame, ids: str, column: str, parts: int, entries: int) -> Codebooks | None:
    """Codebooks of the vectors with the least ids; None if there is no vector to start from."""
    rows = kept(only(vectors, ids, column), column)
    order = [F.col(f"`{ids}`").asc_nulls_last(), F.transform(F.col(f"`{column}`"), lambda x: F.floor(x.cast("double") * SCALE)).asc()]
    first = rows.orderBy(*order).limit(1).toArrow()[column].to_pylist()
    length = len(first[0]) if first else 0
    if not length or length % parts:
        return None
    found = usable(rows, column, length).orderBy(*order).limit(entries).toArrow()[column]
    own = integers(np.array(found.to_pylist(), np.float64).ravel(), length)
    return Codebooks(np.ascontiguousarray(own.reshape(-1, parts, length // parts).transpose(1, 0, 2)))


def in_steps(batches, column: str, length: int):
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part, integers(part[column].flatten().to_numpy(zero_copy_only=False), length)


def moved(vectors: DataFrame, column: str, books: Codebooks) -> Codebooks:
    """One round: every entry to the floor of the mean of the parts nearest to it."""
    number, entries, width = books.entries.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def summed(batches):
        sums, counts = np.zeros((number, entries, width), np.int64), np.zeros((number, entries), np.int64)
        for _, own in in_steps(batches, column, number * width):
            parts = own.reshape(-1, number, width)
            codes, _ = shared.value.nearest(parts)
            for p in range(number):
                order = np.argsort(codes[:, p], kind="stable")
                used, first = np.unique(codes[order, p], return_index=True)
                sums[p, used] += np.add.reduceat(parts[order, p], first, axis=0)
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "parts": counts[part, entry], "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))})

    by_task = usable(kept(only(vectors, column), column), column, books.length).mapInArrow(summed, "part long, entry long, parts long, sums array<long>")
    places = by_task.select("part", "entry", "parts", F.posexplode("sums").alias("position", "total"))
    merged = places.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("parts").alias("parts"))
    out = books.entries.copy()
    for r in merged.collect():  # one for each integer of the codebooks at most
        out[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["parts"]
    shared.unpersist()
    return Codebooks(out)


def fit(vectors: DataFrame, ids: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of a table of vectors, learned from all of them."""
    books = start(vectors, ids, column, parts, entries)
    for _ in range(rounds if books else 0):
        books = moved(vectors, column, books)
    return books


def compress(vectors: DataFrame, books: Codebooks | None, column: str = "embedding") -> DataFrame:
    """All kept rows with ``code`` (two hexadecimal digits a part) and ``error`` (squared distance to what it stands for)."""
    rows = kept(vectors.drop("code", "error"), column)
    if books is None:
        return rows.withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")})
    schema = rows.select("*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    number, length = books.entries.shape[0], books.length

    def coded(batches):
        for part, own in in_steps(batches, column, length):
            codes, least = shared.value.nearest(own.reshape(-1, number, length // number))
            written_out = codes.astype(np.uint8).tobytes().hex()
            names = [written_out[k : k + 2 * number] for k in range(0, len(written_out), 2 * number)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(least.sum(1))], names=schema.names)

    other = rows.where(F.size(F.col(f"`{column}`")) != length).withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")})
    return usable(rows, column, length).mapInArrow(coded, schema).unionByName(other)


def with_group_error(coded: DataFrame, by: str, name: str) -> DataFrame:
    """``coded`` (read twice, so it should be a table) with the errors of all rows of equal ``by``, nulls together."""
    salt, key = unused(coded, "salt"), unused(coded, "of")
    sums = written(coded.groupBy(F.col(f"`{by}`").alias(key)).agg(F.sum("error").alias(name)))
    coded = coded.drop(name)
    same = F.col(f"`{by}`").eqNullSafe(F.col(f"`{key}`"))
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), same).drop(key)
    copies = sums.withColumn(salt + "_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, same & (F.col(f"`{salt}`") == F.col(f"`{salt}_`"))).drop(key, salt, salt + "_")


def compress_table(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of a table of ``vec_id, label, embedding``."""
    books = fit(vectors)
    coded = written(compress(only(vectors, "vec_id", "label", "embedding"), books).drop("embedding"))
    return with_group_error(coded, "label", "label_error").select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


_PARTS = f"range({PARTS}) AS t(p)"


def _assigned(books: str) -> str:
    return f"""SELECT n, p, min(d * {ENTRIES} + e) AS best, any_value(v) AS v FROM (
        SELECT pieces.n, p, e, pieces.v, list_sum(list_transform(list_zip(pieces.v, {books}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM pieces JOIN {books} USING (p)) GROUP BY n, p"""


def _round(assigned: str, books: str) -> str:
    return f"""SELECT p, e, list(x ORDER BY k) AS v FROM (
        SELECT p, e, k, ((s - ((s % c) + c) % c) // c)::BIGINT AS x FROM (
            SELECT p, best % {ENTRIES} AS e, k, sum(x)::HUGEINT AS s, count(*) AS c
            FROM (SELECT p, best, unnest(v) AS x, unnest(range(len(v))) AS k FROM {assigned}) GROUP BY ALL)) GROUP BY p, e
        UNION ALL SELECT p, e, v FROM {books} WHERE (p, e) NOT IN (SELECT p, best % {ENTRIES} FROM {assigned})"""


ORACLE = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, q) - 1 AS n, * FROM (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)),
pieces AS MATERIALIZED (SELECT n, p, q[p * (len(q) // {PARTS}) + 1 : (p + 1) * (len(q) // {PARTS})] AS v FROM kept, {_PARTS}),
book0 AS MATERIALIZED (SELECT p, n AS e, v FROM pieces WHERE n < {ENTRIES}),
near0 AS MATERIALIZED ({_assigned("book0")}),
book1 AS MATERIALIZED ({_round("near0", "book0")}),
near1 AS MATERIALIZED ({_assigned("book1")}),
book2 AS MATERIALIZED ({_round("near1", "book1")}),
near2 AS MATERIALIZED ({_assigned("book2")}),
coded AS (SELECT n, string_agg(format('{{:02x}}', best % {ENTRIES}), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM near2 GROUP BY n),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS k FROM book2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (n), digest
"""
