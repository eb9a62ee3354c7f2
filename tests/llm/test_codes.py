"""The tokenizers' alignment, vector codes and byte-level BPE against plain versions and the public libraries."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm import alignment, bytepair, veccodes

A, B, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"))
MIXED = ["a", "'s", "'", "re", "'re", "'ll", "l", " ", "  ", "\n", "\t", "1", "é", "٣", "!", "'t", "d", "世", "🙂", "V", "'v", "e", "\r\n", "\x1c", "<|endoftext|>", "<s>", "▁", "x" * 70, "ab" * 40, "don't", " we've"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def plain_a():
    own = tokenizers.Tokenizer.from_file(A)
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


def mixed(count, seed, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(MIXED, k=rng.randrange(longest))) for _ in range(count)]


def every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    return ["".join(points[k : k + 500]) for k in range(0, len(points), 500)] + ["".join(f"a{c}1{c}!{c} {c}" for c in points[k : k + 500]) for k in range(0, 0x20000, 500)]


def ids_of(path, texts):
    ids, ends, starts = bytepair.encoder(path)(pa.array(texts, pa.string()))
    assert bytepair.texts_of(bytepair.of_file(path), ids, ends, starts)[0].tobytes() == "".join(t or "" for t in texts).encode()
    return [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]


@pytest.mark.parametrize("texts", [mixed(20000, 1), every_code_point(), ["x" * 5000 + "ab" * 3000, "".join(random.Random(2).choices("abcdef", k=20000)), None, "", " "], []], ids=["mixed", "code points", "long words", "none"])
def test_ids_equal_the_libraries(texts, library, plain_a):
    assert ids_of(RANKS, texts) == [library.encode_ordinary(t or "") for t in texts]
    assert ids_of(A, texts) == [plain_a(t or "") for t in texts]


def test_scan_equals_one_step_after_another():
    of_symbol, compose, functions, _ = bytepair.automaton()
    for f in range(len(functions)):
        assert (functions[compose[f]] == functions[:, functions[f]]).all()
    rng = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 64 * 64 + 1, 300_000):
        symbols = rng.integers(0, 2 * bytepair.SYMBOLS, size)
        state, want = 0, []
        for x in symbols.tolist():
            state = int(functions[of_symbol[x], state])
            want.append(state)
        assert bytepair.states_after(of_symbol[symbols]).tolist() == want


def test_words_are_remembered_and_forgotten(monkeypatch):
    monkeypatch.setattr(bytepair, "CACHE", 40)
    own = bytepair.Encoder(bytepair.of_file(A))
    texts = mixed(400, 5)
    want = ids_of(A, texts)
    for k in range(0, 400, 50):
        ids, _, starts = own(pa.array(texts[k : k + 50]))
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == want[k : k + 50]
        assert len(own.merger.known) <= 40


def test_encode_and_decode_tables(spark, library):
    rows = [(k, t, "kept", [9]) for k, t in enumerate(mixed(300, 7))] + [(None, None, None, None), (3, "", "x", []), (3, "", "x", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>").repartition(5)
    coded = bytepair.decode(bytepair.encode(docs.withColumnRenamed("decoded", "parts"), RANKS), RANKS)
    assert coded.columns == ["doc_id", "text", "parts", "ids", "ends", "decoded"]
    got = coded.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["ends"] == np.cumsum([len(library.decode_single_token_bytes(i)) for i in r["ids"]]).tolist()
    want = Counter((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for k, t, ids in ((r[0], r[1], library.encode_ordinary(r[1] or "")) for r in rows))
    assert Counter(map(tuple, bytepair.digests(coded).collect())) == want
    empty = docs.where("false")
    assert bytepair.digests(bytepair.decode(bytepair.encode(empty, RANKS), RANKS)).collect() == []
    with pytest.raises(Exception, match="don't end where"):
        bytepair.decode(coded.withColumn("ends", F.transform("ends", lambda x: x + 1)), RANKS).collect()


def test_pieces_equal_the_library(monkeypatch):
    """Words one by one give what the library gives for whole texts, also when words are forgotten now and then."""
    monkeypatch.setattr(bytepair, "CACHE", 300)
    own, whole = alignment.Pieces(B), sentencepiece.SentencePieceProcessor(model_file=B)
    texts = mixed(6000, 21) + ["a ", "a", " a ", "  ", "\n", "x" * 3000, "ab " * 2000] + every_code_point()[:300]
    for k in range(0, len(texts), 500):
        part = [t for t in texts[k : k + 500] if t]
        ids, starts, same = own(pa.array([" " + t for t in part], pa.large_string()))
        # A text that holds the mark of a space itself never makes up its text again, whatever its ids.
        assert all("▁" in t or ids[a:b].tolist() == x for t, a, b, x in zip(part, starts[:-1], starts[1:], whole.encode(part), strict=True))
        pieces = [b"".join(own.bytes[i] for i in whole.encode(t)) for t in part]
        assert same.tolist() == [p == (" " + t).encode() for p, t in zip(pieces, part, strict=True)]


def plain_alignment(rows, plain_a):
    """Per document what the query returns, one token after another."""
    letters = bytepair.byte_letters()
    names = {i: bytes(letters[c] for c in t) for t, i in tokenizers.Tokenizer.from_file(A).get_vocab().items() if t != "<|endoftext|>"}
    model = sentencepiece.SentencePieceProcessor(model_file=B)

    def piece(k):
        return bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b = (plain_a(" " + text), model.encode(text)) if text else ([], [])
        if text and not b"".join(map(names.get, a)) == b"".join(map(piece, b)) == (" " + text).encode():
            a, b = [], []
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((names.get, a), (piece, b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [[[i for i, e in zip(ids, own, strict=True) if before < e <= cut] for ids, own in ((a, ends[0]), (b, ends[1]))] for before, cut in zip([-1, *cuts], cuts, strict=False)]
        links = [(x, y) for x, e in zip(a, ends[0], strict=True) for y, f in zip(b, ends[1], strict=True) if e == f]
        counts.update(links)
        told = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        found.append((doc_id, len(a), len(b), len(groups), hashlib.sha256(told.encode()).hexdigest() if a else "", links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return Counter((*head, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links)) for *head, links in found)


def test_alignment_equals_plain_version(spark, plain_a):
    texts = mixed(250, 11, 9) + ["<s> </s> <unk> plain", "x ▁ y", "ﬁne ½", "two  spaces\tand\n\nlines", "twice", "twice", None, ""] + ["word " * 3000]
    rows = [(None if k % 17 == 0 else k % 200, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_a long, salt long").repartition(6)
    got = alignment.align_corpus(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]
    assert Counter(map(tuple, got.collect())) == plain_alignment(rows, plain_a)
    assert alignment.align_corpus(docs.where("false"), A, B).collect() == []
    kept = alignment.align(docs.withColumn("a_ids", F.lit("old")), A, B)
    for r in kept.collect():
        assert len(r["a_ids"]) == len(r["a_groups"]) and len(r["b_ids"]) == len(r["b_groups"]) and len(r["a_linked"]) == len(r["b_linked"])
        assert not r["a_ids"] or r["a_groups"][-1] == r["b_groups"][-1] == len(set(r["a_groups"])) - 1


def test_alignment_links_all_ids_that_end_together():
    """Ids without bytes end where the one before ends: all of them are linked."""
    a = alignment.Side(np.array([1, 2, 3]), np.array([0, 3, 3]), np.array([2, 2, 5]))
    b = alignment.Side(np.array([7, 8, 9]), np.array([0, 3, 3]), np.array([2, 5, 5]))
    found = alignment.align_sides(a, b)
    assert sorted(zip(a.ids[found.linked[0]].tolist(), b.ids[found.linked[1]].tolist(), strict=True)) == [(1, 7), (2, 7), (3, 8), (3, 9)]
    assert found.groups.tolist() == [0, 2, 2] and found.links.tolist() == [0, 4, 4]
    assert alignment.described(found) == [hashlib.sha256(b"1,2|7;3|8,9").hexdigest(), ""]


def plain_codes(rows, parts, entries, rounds):
    good = [(i, x, [math.floor(256 * v) for v in vec]) for i, x, vec in rows if vec is not None and all(v is not None and math.isfinite(v) for v in vec)]
    good.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    width = len(good[0][2]) // parts
    cut = [[q[p * width : (p + 1) * width] for p in range(parts)] for *_, q in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        d = [sum((u - v) ** 2 for u, v in zip(x, e, strict=True)) for e in books[p]]
        return min(d), d.index(min(d))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(near(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(x[k] for x in own[e]) // len(own[e]) for k in range(width)] if e in own else b for e, b in enumerate(books[p])]
    out = [(i, label, *zip(*[near(p, c[p]) for p in range(parts)], strict=True)) for (i, label, _), c in zip(good, cut, strict=True)]
    total = Counter()
    for _, label, d, _ in out:
        total[label] += sum(d)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for k in codes), sum(d), total[label], sha) for i, label, d, codes in out)


SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("code", T.StringType()), T.StructField("part", T.StringType())])


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "old", "own") for r in rows], SCHEMA)


@pytest.mark.parametrize("labels_at_once", [100_000, 1])
def test_codes_equal_plain_version(spark, monkeypatch, labels_at_once):
    monkeypatch.setattr(veccodes, "BROADCAST_LABELS", labels_at_once)
    rng = np.random.default_rng(5)
    rows = [(int(i), None if i % 7 == 0 else int(i % 4), rng.normal(0, 0.4, 32).round(2).tolist()) for i in range(300)]
    rows += [rows[5], rows[5], (None, 1, rows[9][2]), (400, 1, None), (401, 1, [0.5] * 31 + [None]), (402, 1, [0.5] * 31 + [float("nan")]), (403, 1, [float("-inf")] * 32)]
    docs = vectors_of(spark, rows).repartition(7)
    got = veccodes.compress_table(docs)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    floats = [(i, x, None if v is None else [None if u is None else float(np.float32(u)) for u in v]) for i, x, v in rows]
    assert Counter(map(tuple, got.collect())) == plain_codes(floats, 16, 64, 2)


def test_codes_of_few_odd_and_no_vectors(spark):
    few = [(k, k, [0.1 * k] * 16) for k in range(3)]
    assert Counter(map(tuple, veccodes.compress_table(vectors_of(spark, few)).collect())) == plain_codes([(i, x, [float(np.float32(u)) for u in v]) for i, x, v in few], 16, 64, 2)
    other = veccodes.compress_table(vectors_of(spark, [*few, (9, 1, [1.0] * 8), (10, None, [])])).collect()
    assert len(other) == 5 and {(r["vec_id"], r["code"], r["error"]) for r in other if r["vec_id"] > 8} == {(9, None, None), (10, None, None)}
    assert veccodes.compress_table(vectors_of(spark, [(1, 1, [1.0] * 15)])).first()["code"] is None
    assert veccodes.compress_table(vectors_of(spark, [(1, 1, None)])).collect() == []
    kept = veccodes.compress(vectors_of(spark, few), veccodes.fit(vectors_of(spark, few)))
    assert kept.columns == ["vec_id", "label", "embedding", "part", "code", "error"]
    with pytest.raises(Exception, match="too large"):
        veccodes.compress_table(vectors_of(spark, [(1, 1, [1e9] * 16)])).collect()
