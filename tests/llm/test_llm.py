"""The training-data operators against brute force, round trips and held-out accuracy, with nulls, empties, ties and clashing columns."""

import hashlib
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline import storage
from treeline.llm import chosenpath, chroma, decontam, langid, linededup, packing, quality, secrets, sharding, urllist
from treeline.llm import queries as Q

DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t in enumerate(texts)], DOC)


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(100000)}" for _ in range(n)]


ODD = [None, "", " ", "x", "same text here", "same text here", "é \n\n\t ", "long " * 60000]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD).withColumn("score", F.lit("mine")).withColumn("key", F.lit(1)).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_quality_is_learned(spark):
    r = Q.op2_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    good = r.quality == 1
    assert (r.predicted == r.quality).mean() > 0.9 and r.predicted[good].mean() == 1.0


def test_quality_odd_inputs(spark, odd, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    rows = quality.score(odd, quality.fit(odd, labels)).toPandas()
    assert len(rows) == len(ODD) and rows.quality_score.between(0, 1).all() and (rows.score == "mine").all()
    one = quality.fit(odd, labels.where("quality = 1"))
    assert quality.score(odd, one).where("quality_predicted = 0").count() == 0
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0


def test_language(spark, odd, empty):
    r = Q.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (r.lang_pred == r.lang).mean() > 0.95
    out = {x["doc_id"]: x for x in langid.identify(odd, langid.fit(odd)).collect()}
    assert out[0]["lang_predicted"] == out[1]["lang_predicted"] == out[2]["lang_predicted"] == "und" and out[7]["lang_predicted"] == "en"
    assert langid.identify(odd, langid.fit(empty)).where("lang_predicted <> 'und'").count() == 0


def chunk_starts(lines):
    """The first line of each line's chunk, by the same law."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    long = [x.count(" ") >= linededup.LONG_WORDS - 1 for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if i - start == linededup.MOST_LINES:
            start = i
        out.append(start)
        if (h[i] * 31 + (h[i - 1] if i else 0)) % 1000003 % linededup.DIVISOR == 0 or long[i] or long[i + 1 : i + 2] == [True]:
            start = i + 1
    return out, long


def brute_lines(texts):
    """What each text keeps, one text after another: every run that begins or ends at a boundary is looked up among the earlier ones."""
    seen, out = set(), []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        lines = t.split("\n")
        starts, long = chunk_starts(lines)
        last = [k for k in range(len(lines)) if k + 1 == len(lines) or starts[k + 1] != starts[k]]
        runs = set()
        for i in range(len(lines)):
            stop = min(k for k in last if k >= i)
            if i < stop or long[i]:
                runs.add((i, stop))
            elif stop + 1 < len(lines):
                runs.add((i, min(k for k in last if k > stop)))
            if i > starts[i]:
                runs.add((starts[i], i))
            elif i and not long[i]:
                runs.add((starts[i - 1], i))
        gone, own = set(), set()
        for a, b in sorted(runs):
            body = tuple(lines[a : b + 1])
            if any(body) and (body in seen or body in own):
                gone |= set(range(a, b + 1))
            own.add(body)
        seen |= own
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup_equals_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(linededup, "MOST_LINES", 5)
    rng = random.Random(4)
    passages = [[" ".join(words(5, 100 + 7 * p + i)) for i in range(8)] for p in range(4)]
    texts = []
    for k in range(60):
        parts = [[" ".join(words(4, 5000 + 10 * k + i)) for i in range(4)], rng.choice(passages), [" ".join(words(60, rng.randrange(3)))], [" ".join(words(3, 9000 + k))], [""] * rng.randrange(4)]
        texts.append("\n".join(x for p in parts for x in p))
    texts += ["a\na\na\na\nb", "\n".join(["same line"] * 30), *ODD[:-1]]
    got = [r["text"] for r in linededup.dedup(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == brute_lines(texts)
    assert sum(len(t or "") for t in got) < sum(len(t or "") for t in texts)
    assert linededup.dedup(odd).count() == len(ODD)


@pytest.mark.parametrize(("lines", "least"), [(2, 0.2), (4, 0.75), (6, 0.9), (10, 0.95)])
def test_line_dedup_finds_passages_of_short_lines(spark, lines, least):
    passages = ["\n".join(" ".join(words(12, 1000 * n + i)) for i in range(lines)) for n in range(100)]
    own = lambda k: "\n".join(" ".join(words(9, 10**6 + 10 * k + i)) for i in range(3))
    texts = [f"{own(3 * k)}\n{p}\n{own(3 * k + 1)}" for k, p in enumerate([*passages, *passages])]
    rows = linededup.dedup(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert all(r["removed_lines"] == [] for r in rows[:100])
    assert all(set(r["removed_lines"]) <= set(range(3, 3 + lines)) for r in rows[100:])
    assert sum(len(r["removed_lines"]) for r in rows[100:]) >= least * 100 * lines


def test_line_dedup_of_repeated_rows_and_ids(spark):
    passage = "\n".join(" ".join(words(60, k)) for k in range(2))
    rows = [(1, passage), (1, passage), (None, passage), (None, "x\n" + passage), (2, passage + "\nown line"), (3, None)]
    out = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["text"] is None, r["text"] or "") for r in out.collect()) == sorted([(False, passage), (False, passage), (False, ""), (False, "x"), (False, "own line"), (True, "")])
    assert linededup.dedup(out.limit(0)).count() == 0
    # Without ids, or with one id for all, a passage stays in one text, whichever comes first by its hash.
    for doc_id in (None, 3):
        left = linededup.dedup(spark.createDataFrame([(doc_id, f"own {k}\n{passage}\nlast {k}") for k in range(5)], "doc_id long, text string")).collect()
        assert sorted(len(r["removed_lines"]) for r in left) == [0, 2, 2, 2, 2]


def test_line_dedup_writes_small_tables(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = ["\n".join(" ".join(rng.choices(vocabulary, k=12)) for _ in range(40)) for _ in range(1500)]
    docs = docs_of(spark, texts).coalesce(2)
    docs.write.parquet(str(tmp_path / "plain"), compression="snappy")
    weigh = lambda folder: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    shared = Path(storage.shared_dir(spark).removeprefix("file://"))
    before = weigh(shared)
    left = linededup.dedup(docs)
    assert 0 < weigh(shared) - before < 0.8 * weigh(tmp_path / "plain")
    assert [r["text"] for r in left.orderBy("doc_id").collect()] == texts


def test_line_dedup_is_native(spark, odd):
    plan = linededup.dedup(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def jaccard_classes(texts):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").split()) else None for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 - 1e-12:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (find(k), links[k]) for k in range(len(texts))}


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = list(ODD)
    for base in range(6):
        w = words(120, base)
        for _ in range(40):
            v = list(w)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(len(v))] = f"z{rng.randrange(1000)}"
            texts.append(" ".join(v))
    shared = words(50, 77)
    texts += [" ".join(words(40, 500 + k) + shared + words(40, 900 + k)) for k in range(60)]
    # Small nodes and blocks, so that splitting, leaders and blocks against blocks are all used.
    monkeypatch.setattr(chosenpath, "SMALL", 8)
    monkeypatch.setattr(chosenpath, "BLOCK", 16)
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in chosenpath.join(docs_of(spark, texts)).collect()}
    assert got == jaccard_classes(texts)


def test_jaccard_join_finds_partners_of_hub_members(spark, monkeypatch):
    """Members are similar to one hub (0.815); each has partners that are similar to it (0.815) and not to the hub (0.66): their links hang on no leader."""
    hub = words(200, 1)

    def changed(text, places, seed):
        new = list(text)
        for p, w in zip(places, words(len(places), seed), strict=True):
            new[p] = w
        return new

    # Nodes are split far below their usual size, so that members leave nodes with a leader.
    monkeypatch.setattr(chosenpath, "SMALL", 8)
    monkeypatch.setattr(chosenpath, "BLOCK", 16)
    rng, texts, want = random.Random(6), [hub], [("hub", 60)]
    for k in range(60):
        spots = rng.sample(range(5, 195, 6), 12)
        member = changed(hub, spots[:4], 1000 + k)
        texts += [member, *(changed(member, spots[4 * n : 4 * n + 4], 5000 + 10 * k + n) for n in (1, 2))]
        want += [("member", 3), ("partner", 1), ("partner", 1)]
    got = [r["links"] for r in chosenpath.join(docs_of(spark, [" ".join(t) for t in texts])).orderBy("doc_id").collect()]
    assert all(g <= n for g, (_, n) in zip(got, want, strict=True))
    found = lambda kind: sum(g for g, (k, _) in zip(got, want, strict=True) if k == kind) / sum(n for k, n in want if k == kind)
    assert found("hub") >= 0.9 and found("member") >= 0.9 and found("partner") >= 0.9, (found("hub"), found("member"), found("partner"))


def test_jaccard_join_of_nothing(spark, empty):
    assert chosenpath.join(empty).count() == 0


def edit_distance_inside(item, text):
    last = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        now = [i + 1]
        for j, b in enumerate(text):
            now.append(min(last[j] + (a != b), last[j + 1] + 1, now[j] + 1))
        last = now
    return min(last)


def test_decontamination_against_brute_force(spark, empty):
    rng = random.Random(3)
    items = [words(n, 40 + n) for n in (4, 15, 20, 30, 40, 57)]
    texts, want = list(ODD), set()
    for k in range(120):
        item = rng.choice(items)
        w = list(item)
        for _ in range(rng.randrange(int(0.3 * len(item)) + 1)):
            p = rng.randrange(len(w))
            w[p : p + rng.randrange(2)] = words(rng.randrange(2), 10000 + k)
        texts.append(" ".join(words(30, 2000 + k) + w + words(20, 3000 + k)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, " ")], "item_id long, text string")
    for k, t in enumerate(texts):
        for i, w in enumerate(items):
            if len(t or "") < 5000 and edit_distance_inside(w, (t or "").split()) <= decontam.edit_bound(len(w)):
                want.add((k, i))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.contaminated(docs_of(spark, texts), bench).collect()}
    assert set(got) <= want and len(set(got) & want) >= 0.95 * len(want)
    assert all(d == edit_distance_inside(items[i], texts[k].split()) for (k, i), d in got.items())
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_of_common_runs(spark):
    """Runs that many items share, repeated in a text, cost little and hide nothing."""
    shared = words(3, 1)
    items = [words(6, 100 + k) + shared + words(6, 90_000 + k) for k in range(1500)]
    text = " ".join(" ".join(shared + words(1, 5)) for _ in range(3000))
    found = decontam.prepare(list(range(1500)), [" ".join(w) for w in items])
    began = time.perf_counter()
    assert len(decontam.matches(found, [text])[0]) == 0 and time.perf_counter() - began < 5
    hidden = [" ".join([*words(9, 7 + k), *items[k], *words(4, 8 + k)]) for k in range(0, 1500, 50)]
    doc, item, distance, first = decontam.matches(found, [text + " " + hidden[0], *hidden, *hidden])
    assert sorted(zip(doc.tolist(), item.tolist(), strict=True)) == [(0, 0)] + [(1 + k, 50 * (k % 30)) for k in range(60)] and not distance.any()
    # A text that shares a run, but not enough words, alone in its slice.
    assert len(decontam.matches(found, [" ".join(items[0][:5])])[0]) == len(decontam.matches(found, [None])[0]) == 0
    # Items of the shared words alone: each part of them is common, and is found all the same.
    alike = decontam.prepare(list(range(40)), [" ".join(shared * 4)] * 40)
    assert len(decontam.matches(alike, [" ".join([*words(5, 3), *shared * 4])])[0]) == 40


def test_windows_lose_no_match(monkeypatch):
    """With every window verified, what is found equals brute force, also where all runs are common."""
    monkeypatch.setattr(decontam, "rounds", lambda length: None)
    monkeypatch.setattr(decontam, "COMMON", 1)
    rng = random.Random(12)
    few = words(12, 77)
    items = [[rng.choice(few) for _ in range(rng.randrange(1, 25))] for _ in range(60)]
    texts = []
    for k in range(60):
        w = list(items[k])
        for _ in range(rng.randrange(1 + decontam.edit_bound(len(w)))):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = words(rng.randrange(2), 300 + k)
        texts.append(" ".join(words(5, k) + w + words(5, 900 + k)))
    found = decontam.prepare(list(range(60)), [" ".join(w) for w in items])
    for at_once in (1 << 20, 7):
        monkeypatch.setattr(decontam, "AT_ONCE", at_once)
        doc, item, distance, _ = decontam.matches(found, texts)
        want = {(d, i): x for d, t in enumerate(texts) for i, w in enumerate(items) if (x := edit_distance_inside(w, t.split())) <= decontam.edit_bound(len(w))}
        assert {(d, i): x for d, i, x in zip(doc.tolist(), item.tolist(), distance.tolist(), strict=True)} == want


def test_items_without_an_id_count(spark):
    item = " ".join(words(20, 4))
    docs = docs_of(spark, [f"a {item} b", "clean words here"])
    bench = spark.createDataFrame([(None, item), (None, None), (5, " ")], "item_id long, text string")
    assert [tuple(r) for r in decontam.contaminated(docs, bench).select("doc_id", "item_id", "distance").collect()] == [(0, None, 0)]
    assert [r["doc_id"] for r in decontam.clean(docs, bench).collect()] == [1]


@pytest.mark.parametrize("mixed", [False, True])
def test_decontamination_of_long_items_at_the_bound(spark, mixed):
    rng = random.Random(31)
    items = [words(n, 700 + n) for n in (100, 200, 300, 400)]
    texts = []
    for k in range(240):
        w = [[x] for x in items[k % 4]]
        for n, p in enumerate(rng.sample(range(len(w)), decontam.edit_bound(len(w)))):
            w[p] = rng.choice([[f"z{n}"], [], [f"z{n}", *w[p]]]) if mixed else [f"z{n}"]
        texts.append(" ".join([*words(30, 2000 + k), *(x for part in w for x in part), *words(20, 3000 + k)]))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_of(spark, texts), bench).collect()}
    assert got <= {(k, k % 4) for k in range(240)}
    assert all(np.mean([(k, i) in got for k in range(i, 240, 4)]) >= 0.9 for i in range(4)) and len(got) >= 0.95 * 240


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(Q.tokenizer_path())
    rows = packing.pack_documents(odd, Q.tokenizer_path()).toPandas()
    for k, text in enumerate(ODD):
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = rows[rows.doc_id == k].sort_values("start")
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]
    o = rows.sort_values(["sequence_id", "offset"])
    assert (o.groupby("sequence_id").length.cumsum() - o.length == o.offset).all() and o.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("text", ["  a b", " x", "x ", "a\n\nb", "é  \tz", "<|endoftext|> hi", " a b", "a\x85b c", "a \nb", "it's we'll 12 3a!? ...\n", "\0 a"])
def test_encoder_equals_tokenizer(text):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(Q.tokenizer_path())
    ids, starts = packing.encoder(Q.tokenizer_path())([text, None, text])
    assert ids[starts[2] :].tolist() == [*model.encode(text, add_special_tokens=False).ids, 1] and ids[starts[1] : starts[2]].tolist() == [1]


def test_packing_gives_added_tokens_their_ids(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(Q.tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x\n", "  a\t<|endoftext|>  b\n\nc", "a <|endoftext| > b", "plain text", "w " * 3000 + "<|endoftext|> z"]
    rows = packing.pack_documents(docs_of(spark, texts), Q.tokenizer_path()).toPandas()
    for k, text in enumerate(texts):
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = rows[rows.doc_id == k].sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]


def test_vector_packing_keeps_every_limit():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 900, 400)
    loss = (tokens * rng.random(400)).astype(int)
    bins = packing.dot_product_packing(tokens, loss, (1000, 5, 900))
    assert np.bincount(bins, tokens).max() <= 1000 and np.bincount(bins).max() <= 5 and np.bincount(bins, loss).max() <= 900
    with pytest.raises(ValueError):
        packing.dot_product_packing(np.array([2000]), np.array([1]), (1000, 5, 600))


def test_sharding(spark, odd, empty):
    r = sharding.shard(spark.read.parquet(f"{DIR}/documents.parquet"), 8).toPandas()
    sizes = r.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.02 * sizes.mean() + r["size"].max() and r.groupby("group_key").shard.nunique().max() == 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in r.groupby("shard"))
    o = sharding.shard(odd, 3).toPandas()
    assert len(o) == len(ODD) and o["size"].sum() == sum(len((t or "").encode()) + 1 for t in ODD) and sharding.shard(empty, 3).count() == 0


def plain_best_fit(sizes, capacity):
    """Item by item: the open bin with the least room that is enough, the lowest of equals."""
    room, out = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= s]
        if not fits:
            room.append(max(capacity, s))
            fits = [(room[-1], len(room) - 1)]
        _, k = min(fits)
        room[k] -= s
        out.append((s, k))
    return out


def test_best_fit_decreasing_equals_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        sizes, capacity = [rng.choice([rng.randint(1, 40), 7, 12]) for _ in range(rng.randint(1, 60))], rng.randint(20, 90)
        counted = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        got = [(s, b) for (s, _), taken in zip(counted, sharding.best_fit_decreasing(counted, capacity), strict=True) for b, n in taken for _ in range(n)]
        assert sorted(got) == sorted(plain_best_fit(sizes, capacity))


def test_sharding_of_many_equal_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    monkeypatch.setattr(sharding, "EXACT", 5)
    rng = random.Random(6)
    texts = ["hot"] * 300 + [f"{k:05d}" for k in range(300)] + ["x" * rng.randint(1, 900) for _ in range(200)] + [None, "", None]
    docs = spark.createDataFrame([(None if k % 50 == 0 else k % 400, t, "mine", k) for k, t in enumerate(texts)], "doc_id long, text string, shard string, slot int")
    r = sharding.shard(docs, 7).toPandas()
    assert len(r) == len(texts) and r.groupby("group_key").shard.nunique().max() == 1 and set(r.shard) == set(range(7))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in r.groupby("shard"))
    sizes = r.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 0.05 * sizes.mean() + r.groupby("group_key")["size"].sum().max()
    assert r.text_crc32.sum() == sum(zlib.crc32((t or "").encode()) for t in texts)


def plain_dot_product(items, limits):
    """Item by item over the whole list: the best scaled product with the room left, of those that fit."""
    demand = [[x / m for x, m in zip(i, limits, strict=True)] for i in items]
    weight = [sum(d[k] for d in demand) / len(items) for k in range(3)]
    todo, bins = list(range(len(items))), []
    while todo:
        room, own = list(limits), []
        while fits := [i for i in todo if all(a <= b for a, b in zip(items[i], room, strict=True))]:
            best = max(fits, key=lambda i: (round(sum(w * d * r / m for w, d, r, m in zip(weight, demand[i], room, limits, strict=True)), 12), [-x for x in items[i]]))
            todo.remove(best)
            own.append(items[best])
            room = [a - b for a, b in zip(room, items[best], strict=True)]
        bins.append(sorted(own))
    return sorted(bins)


def test_vector_packing_equals_plain_search():
    rng = random.Random(12)
    for _ in range(20):
        items = [(t := rng.randint(1, 90), 1, rng.randint(0, min(t, 70))) for _ in range(40)]
        limits = (100, 6, 70)
        bins = packing.dot_product_packing(np.array([i[0] for i in items]), np.array([i[2] for i in items]), limits)
        got = sorted(sorted(items[k] for k in np.flatnonzero(bins == b)) for b in range(bins.max() + 1))
        assert got == plain_dot_product(items, limits)


def test_packing_pads_little(spark):
    rows = packing.pack_documents(spark.read.parquet(f"{DIR}/documents.parquet"), Q.tokenizer_path())
    used, sequences = rows.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert used >= 0.98 * 2048 * (sequences - 1)


def test_packing_refuses_other_tokenizers(tmp_path):
    import json

    stored = json.loads(open(Q.tokenizer_path(), encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": stored["model"] | {"dropout": 0.1}}, {"model": stored["model"] | {"merges": stored["model"]["merges"][::-1]}}):
        (tmp_path / "other.json").write_text(json.dumps(stored | change), encoding="utf-8")
        with pytest.raises(ValueError):
            packing.encoder(str(tmp_path / "other.json"))


CLASHES = ["quality_score", "lang_predicted", "lang_score", "_id", "_key", "_removed", "_chunks", "lines", "removed_lines", "_url", "page", "day", "hit", "group", "shard", "slot", "sketch", "key", "class_id", "links", "kept", "sequence_id", "n", "x", "i", "row"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Repeated and null ids, repeated rows, ties, and columns with the names that operators use inside."""
    base = " ".join(words(80, 5))
    near = base + " end"
    rows = [(1, base), (5, near), (5, "another text that is alone with its words here"), (None, near + " x"), (None, "lone text of a row without an id"), (7, "twice the same row"), (7, "twice the same row"), (8, None), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumns({c: F.lit(f"mine {c}") for c in CLASHES}).persist()


def test_clashing_columns_pass_unchanged(spark, clashing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 1), (9, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(0, " ".join(words(30, 1)))], "item_id long, text string")
    for out, new in (
        (quality.score(clashing, quality.fit(clashing, labels)), {"quality_score"}),
        (langid.identify(clashing, langid.fit(clashing.withColumn("lang", F.lit("en")))), {"lang_predicted", "lang_score"}),
        (linededup.dedup(clashing), {"lines", "removed_lines"}),
        (decontam.clean(clashing, bench), set()),
    ):
        rows = out.collect()
        assert len(rows) == 10 and len(set(out.columns)) == len(out.columns)
        assert all(r[c] == f"mine {c}" for r in rows for c in CLASHES if c not in new)
    assert decontam.contaminated(clashing, bench).count() == 0
    assert sharding.shard(clashing, 2).count() == packing.pack_documents(clashing, Q.tokenizer_path()).count() == 10
    assert secrets.scan(clashing, secrets.fit(secrets.labelled_findings(spark, count=200), trees=3)).count() == 0
    captures = clashing.select("*", F.lit("http://bad.org/").alias("url"), F.lit("2024-02-02").cast("date").alias("fetched_on"))
    entries = spark.createDataFrame([("bad.org", "block", "2024-01-01")], "pattern string, status string, listed_on string")
    judged = urllist.judge(captures, entries).collect()
    assert len(judged) == 10 and all(r["blocked"] and r["page"] == "mine page" for r in judged)


def test_jaccard_join_tells_rows_apart(clashing):
    rows = [tuple(r) for r in chosenpath.join(clashing).select("doc_id", "class_id", "links", "kept").collect()]
    want = [(1, 1, 2, True), (5, 1, 2, False), (5, 5, 0, True), (None, 1, 2, False), (None, None, 0, True), (7, 7, 1, True), (7, 7, 1, True), (8, 8, 0, True), (8, 8, 0, True), (9, 9, 0, True)]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_decontamination_judges_rows_by_themselves(spark):
    item = " ".join(words(30, 1))
    docs = spark.createDataFrame([(1, f"a {item} b"), (1, "clean text"), (None, item), (None, "clean too"), (2, item), (2, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert sorted(r["text"] for r in decontam.clean(docs, bench).collect()) == ["clean text", "clean too"]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in decontam.contaminated(docs, bench).collect()) == [(False, 1), (False, 2), (False, 2), (True, 0)]


def test_repeated_ids_dont_flood_the_samples(spark):
    docs = spark.createDataFrame([(1, f"word{k % 3} text", "en") for k in range(3000)] + [(k, "mot de la phrase", "fr") for k in range(10, 40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)] + [(k, 0) for k in range(10, 40)], "doc_id long, quality int")
    assert set(langid.fit(docs).langs) == {"en", "fr"}
    assert quality.score(docs, quality.fit(docs, labels)).where("quality_predicted = 1").count() >= 3000


def test_all_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 300)
    rng = random.Random(2)
    rows = [(k, " ".join(f"{chr(0x4E00 + 40 * n + rng.randrange(40))}{chr(0x4E00 + 40 * n + rng.randrange(40))}" for _ in range(20)), f"l{n:03d}") for k, n in enumerate(n for n in range(250) for _ in range(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    known = {r["lang"] for r in docs.where(langid.fold("doc_id", 3) != 1).select("lang").distinct().collect()}
    assert set(model.langs) == known and len(known) > 200
    assert np.mean([r["lang"] == r["lang_predicted"] for r in langid.identify(docs.where(F.col("lang").isin(*known)), model).collect()]) > 0.9


def test_secrets(spark, odd, empty):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    known = secrets.corpus_words(docs)
    counts = {}
    for r in docs.collect():
        for w in {x.strip(secrets.string.punctuation).lower() for x in set((r["text"] or "").split())}:
            counts[w] = counts.get(w, 0) + 1
    often = {w for w, n in counts.items() if n >= 4 and w.isalpha() and 4 <= len(w) <= 16}
    assert often <= known and len(known) <= secrets.WORDS and secrets.corpus_words(empty) == frozenset()
    model = secrets.fit(secrets.labelled_findings(spark, known, 2400), trees=30)
    held = model.judge(secrets.labelled_findings(spark, known, 800, seed=77)).toPandas()
    precision, recall = held.label[held.score >= 0.5].mean(), (held.score[held.label == 1] >= 0.5).mean()
    assert precision > 0.93 and recall > 0.93
    texts = ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x', "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "tiontheandingerentouqueier and", 'password = "Xk9mQz71vB"', "password: Xk9#qT2!mZ7$wR4@", "see https://user:hR7xq92LmZ@host.org/a", "password: required field", "the key: value words follow", "Password = '********'"]
    got = {(r["doc_id"], r["start"]): r["is_secret"] for r in secrets.scan(docs_of(spark, texts), model, known).collect()}
    assert {k: v for k, v in got.items() if k[0] < 6} == {(0, 9): 1, (1, 7): 0, (2, 0): 0, (3, 12): 1, (4, 10): 1, (5, 17): 1}
    assert sum(v for k, v in got.items() if k[0] > 5) == 0
    assert secrets.scan(odd, model, known).count() == 0 and secrets.scan(empty, model).count() == 0
    twice = spark.createDataFrame([(None, texts[0]), (None, texts[0]), (1, texts[0] + "\n" + texts[0])], "doc_id long, text string")
    assert secrets.scan(twice, model, known).where("is_secret = 1").count() == 4


@pytest.mark.parametrize("size", [100, 140, 5000])
def test_secrets_of_any_length_are_candidates(size):
    value = ("Xk9#qT2!mZ7$" * 1000)[:size]
    for text, at in ((f'password = "{value}" x', 12), (f"token: {value} x", 7), (f"see https://u:{value}@host.org", 14), (f"pwd='{value}'", 5)):
        assert (at, at + size) in [s[:2] for s in secrets.spans(text)]


def test_url_list(spark):
    from datetime import date

    entries = spark.createDataFrame([("bad.org", "block", date(2024, 1, 10)), ("bad.org", "none", date(2024, 3, 1)), ("a.bad.org/ok", "allow", date(2024, 1, 20)), ("tie.org", "allow", date(2024, 1, 1)), ("tie.org", "block", date(2024, 1, 1)), (None, "block", date(2024, 1, 1))], "pattern string, status string, listed_on date")
    asked = [("http://bad.org/x", date(2024, 1, 9), False), ("http://bad.org/x", date(2024, 1, 10), True), ("https://u@A.Bad.org:8/ok/z?q", date(2024, 1, 19), True), ("https://a.bad.org/ok/z", date(2024, 1, 20), False), ("http://a.bad.org/okay", date(2024, 2, 20), True), ("http://bad.org/x", date(2024, 3, 1), False), ("http://tie.org", date(2025, 1, 1), True), ("nothing", date(2024, 2, 1), False), (None, date(2024, 2, 1), False), ("http://bad.org/x", None, False), ("http://bad.org/x", date(2024, 1, 10), True)]
    rows = urllist.judge(spark.createDataFrame([(k, u, d, 1) for k, (u, d, _) in enumerate(asked)], "page_id int, url string, fetched_on date, status int"), entries).orderBy("page_id").collect()
    assert [r["blocked"] for r in rows] == [b for _, _, b in asked]
    assert urllist.judge(spark.createDataFrame([], "page_id int, url string, fetched_on date"), entries).count() == 0


def test_chroma_finds_shifted_and_noisy_recordings(spark):
    rng = np.random.default_rng(5)
    base = [chroma.melody(rng.normal(size=96)) for _ in range(25)]
    rows = [(k, s) for k, s in enumerate(base)]
    rows += [(100 + k, np.concatenate([np.zeros(chroma.HOP * 3), s, np.zeros(chroma.HOP)]) + rng.normal(scale=0.02, size=len(s) + chroma.HOP * 4)) for k, s in enumerate(base)]
    rows += [(200, base[0]), (300, np.full(9000, np.nan)), (301, np.zeros(0)), (302, None)]
    audio = spark.createDataFrame([(k, None if s is None else [float(x) for x in s]) for k, s in rows], "rec_id long, sound array<float>")
    members, matches = chroma.align(chroma.fingerprints(audio), every=1)
    m = {r["rec_id"]: r["class_id"] for r in members.collect()}
    assert len(m) == len(rows) and m[200] == 0 and m[301] == 301 and m[302] == 302
    found = {(r["class_id"], r["match_class"]): r for r in matches.collect()}
    hits = [(k, 100 + k) in found and abs(found[k, 100 + k]["offset"] + 3) <= 1 for k in range(25)]
    assert np.mean(hits) >= 0.9 and not [p for p in found if p[0] % 100 != p[1] % 100 and p[0] < 200 and p[1] < 200]


def test_chroma_index_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chroma, "BLOCK", 2000)  # several passes
    rng = np.random.default_rng(9)
    prints = [rng.integers(0, 1 << 32, 50, dtype=np.uint32) for _ in range(60)]
    for k in range(60):
        flips = np.packbits(rng.random((50, 32)) < rng.uniform(0.1, 0.22), axis=1).view(np.uint32).ravel()
        cut = int(rng.integers(0, 20))
        prints.append((prints[k] ^ flips)[cut:])
    prints += [prints[0][:5], np.repeat(prints[1][:1], 50), np.repeat(prints[1][:1], 70)]

    def least(a, b):
        errors = [1.0]
        for o in range(-len(b), len(a)):
            x, y = a[max(0, o) : o + len(b)], b[max(0, -o) : len(a) - o]
            if len(x) >= 0.5 * min(len(a), len(b)):
                errors.append(np.bitwise_count(x ^ y).sum() / (32 * len(x)))
        return min(errors)

    n = len(prints)
    true = {(a, b) for a in range(0, n, 2) for b in range(n) if a != b and least(prints[a], prints[b]) <= chroma.MOST_ERROR}
    rows = spark.createDataFrame([(k, p.tobytes().hex(), bytearray(p.astype("<u4").tobytes())) for k, p in enumerate(prints)], "rec_id long, print_key string, ints binary")
    found = [(r["class_id"], r["match_class"]) for r in chroma.align(rows, every=2)[1].collect()]
    assert len(found) == len(set(found)) and set(found) <= true
    assert len(true) > 40 and len(found) >= 0.9 * len(true)
    none = chroma.align(rows.limit(0))
    assert none[0].count() == none[1].count() == 0


def prints_of(spark, prints):
    return spark.createDataFrame([(k, p.tobytes().hex(), bytearray(p.astype("<u4").tobytes())) for k, p in prints.items()], "rec_id long, print_key string, ints binary")


def flipped(ints, share, rng):
    """``ints`` with that share of all bits flipped."""
    bits = np.unpackbits(ints.view(np.uint8))
    bits[rng.choice(len(bits), int(share * len(bits)), replace=False)] ^= 1
    return np.packbits(bits).view(np.uint32)


def test_chroma_finds_the_least_overlap_at_the_largest_error(spark):
    rng = np.random.default_rng(21)
    base = [rng.integers(0, 1 << 32, 50, dtype=np.uint32) for _ in range(1600)]
    prints = {2 * k: p for k, p in enumerate(base)}
    for k in range(400):
        prints[2 * k + 1] = np.concatenate([flipped(base[k][25:], 0.19, rng), rng.integers(0, 1 << 32, 25, dtype=np.uint32)])
    found = {(r["class_id"], r["match_class"]) for r in chroma.align(prints_of(spark, prints), every=2)[1].collect()}
    assert np.mean([(2 * k, 2 * k + 1) in found for k in range(400)]) >= 0.9


def test_chroma_finds_short_recordings(spark):
    rng = np.random.default_rng(22)
    prints = {}
    for k in range(60):
        prints[2 * k] = rng.integers(0, 1 << 32, 5 + k % 27, dtype=np.uint32)
        start = (len(prints[2 * k]) + 1) // 2
        prints[2 * k + 1] = np.concatenate([rng.integers(0, 1 << 32, 3 + k, dtype=np.uint32), flipped(prints[2 * k][:start], 0.18, rng)])
    rows = chroma.align(prints_of(spark, prints), every=2)[1].collect()
    found = {(r["class_id"], r["match_class"]): r["offset"] for r in rows}
    assert len(rows) == len(found) and all(found.get((2 * k, 2 * k + 1)) == -(3 + k) for k in range(60))


STAGE_CLASHES = ("_text", "_gone", "_key", "_place", "text_key", "class_id", "kept", "tokens", "h", "quality_score", "removed_lines", "sequence_id", "group")


@pytest.fixture(scope="module")
def crowded(spark):
    """Rows with nulls, repeats, ties and names that clash with those of the stages."""
    long = [" ".join(words(70, 900 + k)) for k in range(4)]
    texts = [(1, long[0], "en"), (1, long[0], "de"), (1, long[0], "en"), (2, long[0], "en"), (None, long[1], None), (None, long[1], None), (3, long[2], "fr"), (3, long[3], "fr"), (4, None, None), (5, "", "en"), (None, None, None)]
    docs = spark.createDataFrame([(*r, "s", 7) for r in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("own") for c in STAGE_CLASHES})


def test_near_duplicate_stage(spark, crowded):
    import corpus_pipeline

    out = corpus_pipeline.near_duplicate_stage(spark, crowded, "")
    assert out.columns == crowded.columns
    left = sorted(((r["doc_id"], r["text"], r["lang"]) for r in out.collect()), key=repr)
    long = [r["text"] for r in crowded.where("text <> ''").orderBy("doc_id").collect()]
    # Of the rows 1 with one text the German one comes first; row 2 has the same text and goes.
    assert [x for x in left if x[1] == long[-1] or x[0] == 3] and len([x for x in left if x[0] == 1]) == 1 and [x[2] for x in left if x[0] == 1] == ["de"]
    assert not [x for x in left if x[0] == 2] and len([x for x in left if x[0] == 3]) == 2 and len([x for x in left if x[0] is None and x[1]]) == 1
    assert len([x for x in left if not x[1]]) == 3
    assert corpus_pipeline.near_duplicate_stage(spark, crowded.where("false"), "").collect() == []


@pytest.mark.parametrize("stage", ["quality_classifier", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"])
def test_stages_of_clashing_and_empty_tables(spark, crowded, tmp_path, stage):
    import corpus_pipeline

    base = str(tmp_path)
    spark.createDataFrame([(k, 1, 0) for k in (1, 2, 3, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(0, " ".join(words(30, 1))), (None, " ".join(words(70, 902)))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    step = dict(corpus_pipeline.STAGES)[stage]
    out, none = step(spark, crowded, base), step(spark, crowded.where("false"), base)
    assert none.columns == out.columns and none.collect() == []
    rows = out.collect()
    if stage == "packing":
        assert {"doc_id", "start", "sequence_id"} <= set(out.columns) and len(rows) >= crowded.count()
        return
    assert out.columns == crowded.columns and all(r[c] == "own" for r in rows for c in STAGE_CLASHES)
    want = {"quality_classifier": 11, "line_dedup": 11, "ngram_jaccard_join": 7, "decontamination": 10}[stage]
    assert len(rows) == want


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    base = f"{tmp_path}/sf"
    items = [" ".join(words(30, 1))]
    texts = ODD[:-1] + [" ".join(words(80, 50 + k)) for k in range(6)] + [" ".join(words(80, 50))] + ["x " + items[0] + " y"]
    docs_of(spark, texts).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(14)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(0, items[0])], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, base).select("doc_id").collect()}
    assert set(range(7, 13)) <= left and 15 - 1 not in left and len(texts) - 1 not in left
