"""Models and corpus-wide operators against brute force and held-out rows."""

import hashlib
import random
import resource
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronosift.llm import components, decontamination, lm, near_dedup, quality, suffix_dedup

from .helpers import corpus, edits_within, empty, frame, near_components, repeats, words

ROWS = corpus()


def test_near_dedup(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(frame(spark)).collect()}
    assert got == near_components(ROWS)
    assert near_dedup.near_dedup(empty(spark)).count() == 0


def test_near_dedup_chain_of_edits(spark):
    """A large group whose members differ pairwise, and links only along a chain."""
    base = words(9, 150).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(i % 12):
            w[3 + 12 * k] = f"edit{i}"
        rows.append((i, " ".join(w), None, None, 0))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    assert got == near_components(rows)


def test_near_dedup_in_a_template_group(spark):
    """Pairs at 0.77 among many documents of one template at 0.73: too many neighbours for a fixed reach."""
    template, rows = words(50, 300), []
    for i in range(240):
        rows.append((i, f"{template} {' '.join(f'own{i}x{k}' for k in range(54))}", "en", "s", 0))
    for i in range(30):
        rows.append((1000 + i, " ".join(rows[i][1].split()[:308]) + " " + " ".join(f"late{i}x{k}" for k in range(46)), "en", "s", 0))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    assert got == near_components(rows)
    assert all(got[1000 + i][1] == i for i in range(30)) and all(got[i][2] for i in range(240))


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (7, 2), (300, 300)]
    d = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components.components(d).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 2: 1, 7: 1}


def test_components_in_few_jobs(spark):
    """What a round costs the driver: its two exchanges, the table and a look at it."""
    links = spark.range(300).selectExpr("id as a", "id - id % 3 as b")
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("components-test", "")
    try:
        got = components.components(links)
        jobs = len(seen.getJobIdsForGroup("components-test"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.id: r.component for r in got.collect()} == {i: i - i % 3 for i in range(300)}
    assert jobs <= 10, jobs


def test_suffix_dedup(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark)).collect()}
    assert got == repeats(ROWS)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_suffix_dedup_passages(spark):
    r = random.Random(5)
    passages = [words(100 + i, 12) for i in range(4)]
    rows = []
    for i in range(40):
        parts = [words(1000 + 7 * i + k, r.randint(1, 20)) for k in range(3)]
        parts.insert(1, passages[i % 4][: r.randint(45, 60)])
        rows.append((i, "".join(parts), None, None, 0))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == repeats(rows)


def test_multikey_order():
    w = np.random.default_rng(1).integers(0, 3, (500, 4)).astype(np.uint64)
    order, same = suffix_dedup.multikey_order(w)
    rows = [tuple(x) for x in w[order].tolist()]
    assert rows == sorted(rows)
    assert same.tolist() == [False, *[a == b for a, b in zip(rows, rows[1:])]]


def test_decontamination(spark):
    r = random.Random(3)
    items = [(i, words(500 + i, n)) for i, n in enumerate((3, 12, 30, 60))] + [(9, None), (10, "..."), (11, "abcdefghijklmn"), (12, "qzx"), (13, "abcdefghijklmn")]
    rows = []
    for i in range(40):
        t = items[i % 4][1]
        changed = list(t)
        for _ in range(i // 4):
            changed[r.randrange(len(changed))] = r.choice("xyz")
        rows.append((i, f"{words(i, 30)}\n{''.join(changed).upper()} {words(900 + i, 30)}" if i % 5 else words(i, 60), None, None, 0))
    rows += [(100, None, None, None, None), (101, "", None, None, 0), (102, "ko abcdefgxhijklmn ko", None, None, 0), (103, "ko q.z x ko", None, None, 0), (104, "koabcdefgijklmnko", None, None, 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontamination.contamination(frame(spark, rows), bench).collect()}
    for i, t, *_ in rows:
        data, found = decontamination.compact(t or ""), {}
        for item, text in items:
            for p in decontamination.patterns_of(decontamination.compact(text or "")):
                e = edits_within(p, data)
                if e <= decontamination.budget(len(p)):
                    found[item] = min(e, found.get(item, e))
        top = min(((e, k) for k, e in found.items()), default=(None, None))
        assert (got[i].edits, got[i].item_id, got[i].n_items, got[i].contaminated) == (*top, len(found), bool(found))
    assert not decontamination.contamination(frame(spark, rows), bench.where("false")).where("contaminated").count()
    assert decontamination.contamination(empty(spark), bench).count() == 0


def test_decontamination_bounds_hold_for_every_length():
    for m in range(1, 2 * decontamination.PATTERN):
        assert decontamination.bound(m) >= 1 and decontamination.gram_size(m) >= 1
    item = decontamination.compact(words(31, 90))
    for at in range(0, len(item) - decontamination.PATTERN - decontamination.PATTERN_STEP):
        part = item[at : at + decontamination.PATTERN + decontamination.PATTERN_STEP]
        assert any(p in part for p in decontamination.patterns_of(item))


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_BENCHMARK_BYTES", 10)
    bench = spark.createDataFrame([(i, words(i, 20)) for i in range(4)], "item_id long, text string")
    rows = [(i, words(i, 20), None, None, 0) for i in range(6)]
    got = {r.doc_id: (r.contaminated, r.item_id) for r in decontamination.contamination(frame(spark, rows), bench).collect()}
    assert got == {i: (i < 4, i if i < 4 else None) for i in range(6)}


def test_decontamination_of_odd_rows_in_blocks(spark, monkeypatch):
    """Rows that share an id, or have none, are judged alone whatever the benchmark's size."""
    bench = spark.createDataFrame([(i, words(i, 20)) for i in range(4)], "item_id long, text string")
    rows = [(7, words(0, 20)), (7, words(90, 20)), (7, words(3, 20) + " " + words(1, 20)), (None, words(2, 20)), (None, "clean")]
    d = frame(spark, [(i, t, None, None, 0) for i, t in rows]).withColumn("row", F.lit(1))
    one = sorted(map(str, decontamination.contamination(d, bench).collect()))
    monkeypatch.setattr(decontamination, "MAX_BENCHMARK_BYTES", 10)
    several = decontamination.contamination(d, bench)
    assert sorted(map(str, several.collect())) == one and len(one) == 5
    assert several.columns == ["doc_id", "contaminated", "item_id", "edits", "n_items"]


@pytest.mark.parametrize("pairs,region", [(2 << 20, 1 << 20), (50, 1 << 20), (700, 40)])
def test_runs_of_one_character_equal_brute_force(monkeypatch, pairs, region):
    monkeypatch.setattr(decontamination, "PAIRS", pairs)
    monkeypatch.setattr(decontamination, "REGION", region)
    items = [(1, b"0" * 120), (2, b"0" * 60 + b"ab" * 40), (3, b"0" * 20), (4, decontamination.compact(words(3, 30)))]
    index = decontamination.Index(items)
    for text in ("0" * 400, "x" * 50 + "0" * 95 + "y" + "0" * 30, "0" * 60 + "ab" * 60 + "0" * 50, words(3, 30) + "0" * 19, "ab" * 200, "0" * 18 + "1"):
        data, want = decontamination.compact(text), {}
        for item, raw in items:
            for p in decontamination.patterns_of(raw):
                e = edits_within(p, data)
                if e <= decontamination.budget(len(p)):
                    want[item] = min(e, want.get(item, e))
        assert {i: e for i, e, _ in index.matches(text)} == want, text


def test_a_million_of_one_character():
    index = decontamination.Index([(1, b"0" * 120)])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert index.matches("0" * 1_000_000) == [(1, 0, 96)]
    assert time.time() - began < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_suffix_dedup_of_odd_ids(spark):
    p = words(70, 20)
    rows = [(3, p + " x"), (None, p + " y"), (None, p), (5, "z " + p), (5, "w " + p), (9, None), (None, None)]
    d = frame(spark, [(i, t, None, None, 0) for i, t in rows]).withColumn("pack", F.lit(1)).withColumn("ids", F.lit("x")).withColumn("n_bytes", F.lit(2))
    got = suffix_dedup.remove_repeats(d, with_text=True).collect()
    want = repeats([(i, t) for i, t in rows if i not in (None, 5)])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id in (3, 9)} == want
    assert sorted((r.n_removed, bytes(r.kept)) for r in got if r.doc_id == 5) == sorted((len(p.encode()), x) for x in (b"z ", b"w "))
    none = sorted((r.n_removed, r.n_spans, bytes(r.kept).decode(), r.kept_sha256) for r in got if r.doc_id is None)
    assert none == sorted((0, 0, t, hashlib.sha256(t.encode()).hexdigest()) for t in (p + " y", p, ""))
    assert suffix_dedup.remove_repeats(d.where("doc_id IS NULL")).count() == 3


def junk(i: int) -> str:
    return " ".join(w + "###" for w in words(i, 60).split()) if i % 2 else words(i, 60).upper().replace(" ", "!! ")


def test_quality(spark):
    rows = ROWS + [(1000 + i, junk(i) if i % 3 == 0 else words(i, 80), None, None, 0) for i in range(400)]
    labels = spark.createDataFrame([(1000 + i, int(i % 3 != 0), 0) for i in range(400)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(frame(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    out = [i for i in range(400) if zlib.crc32(str(1000 + i).encode()) % 5 == 0]
    assert all(got[1000 + i].held_out for i in out)
    assert sum(got[1000 + i].predicted == (i % 3 != 0) for i in out) >= 0.95 * len(out)
    assert quality.quality_scores(empty(spark), labels).count() == 0
    assert quality.quality_scores(frame(spark), labels.where("false")).select("score").distinct().count() == 1


def test_quality_gradients():
    net = quality.Net()
    chunks = np.vstack([quality.chunks_of(words(i, 60).encode()) for i in range(3)])
    own = np.sort(np.arange(len(chunks)) % 3)
    y = np.array([0.0, 1.0, 1.0])

    def loss():
        p = net.pooled(chunks)
        f = np.stack([np.hstack([p[own == i].mean(0), p[own == i, : quality.FILTERS].max(0)]) for i in range(3)])
        s = 1 / (1 + np.exp(-net.head(f)[1]))
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g = net.gradients(chunks, own, 3, y)
    for k in ("u", "v", "c", "d", "b"):
        at = (0,) * net.p[k].ndim
        net.p[k][at] += 1e-2
        up = loss()
        net.p[k][at] -= 2e-2
        down = loss()
        net.p[k][at] += 1e-2
        assert abs((up - down) / 2e-2 - g[k][at]) < 5e-3, k


def test_lm_base_and_model(spark):
    from math import log10

    rows = ROWS + [(2000 + i, words(i % 30, 50), None, None, 0) for i in range(120)]
    got = {r.doc_id: r for r in lm.lm_scores(frame(spark, rows)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t, *_ in rows}
    count: dict = {}
    for i, t in toks.items():
        if not held(i):
            for w in t:
                count[w] = count.get(w, 0) + 1
    total, v = sum(count.values()), len(count)
    for i, t in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(w in count for w in t), total)
        assert abs(r.base_score - sum(log10((count.get(w, 0) + 1) / (total + v + 1)) for w in t)) < 1e-6
        assert r.score < 0
    # word salad is less likely per character than what was learned
    assert got[2001].score / len(words(1, 50)) > got[12].score / len(ROWS[12][1])
    assert lm.lm_scores(empty(spark)).count() == 0


def naive_score(s, text: str) -> float:
    """Window by window and id by id, in plain double precision."""
    p, v = {k: a.astype(float) for k, a in s.model.p.items()}, s.vocabulary
    ids = s.ids([text])[0].tolist()
    starts, first = lm.layout(len(ids))
    total, scored = 0.0, set()
    for start, f in zip(starts.tolist(), first.tolist()):
        places = range(start, min(len(ids), start + lm.WINDOW))
        h = np.array([p["e"][s.model.start if i == 0 else v.embedding_of[ids[i - 1]]] + p["pos"][i - start] for i in places])
        q, k, val = h @ p["q"], h @ p["k"], h @ p["v"]
        for row, i in enumerate(places):
            if row < f:
                continue
            a = np.exp([q[row] @ k[j] / lm.DIM**0.5 for j in range(row + 1)])
            y = h[row] + (a / a.sum()) @ val[: row + 1] @ p["o"]
            classes = np.exp(np.maximum(y @ p["w1"] + p["b1"], 0) @ p["w2"] + y @ p["w3"] + p["b"])
            c = v.class_of[ids[i]]
            lo, hi = v.edges[c], v.edges[c + 1]
            inside = np.exp(p["u"][lo:hi] @ y + v.log_within[v.order[lo:hi]] * np.log(10))
            total += np.log10(classes[c] / classes.sum() * inside[v.rank[ids[i]] - lo] / inside.sum())
            assert i not in scored
            scored.add(i)
    assert len(scored) == len(ids)
    return total


def small_scorer() -> lm.Scorer:
    texts = [words(i, 40) for i in range(12)]
    plain = lm.Scorer(lm.Vocabulary.of_counts(np.ones(lm.vocabulary_size(lm.WORD_BPE) + 1, int)), lm.Attention(1))
    counts = sum(np.bincount(x, minlength=plain.end + 1) for x in plain.ids(texts))
    v = lm.Vocabulary.of_counts(counts)
    s = lm.Scorer(v, lm.Attention(v.n_classes, vocabulary=v))
    return s.start_from(np.vstack([w for i, t in enumerate(texts) for w in s.segments(t, i, 1)]))


def test_lm_words_move_once(spark, monkeypatch):
    """Counts go back to the blocks in packs: no join of a row per word and block, whose rows were most of the disk."""
    import pyarrow as pa

    monkeypatch.setattr(lm, "PACK_ROWS", 50)
    held = [(k, w.encode(), n) for k in range(30) for w, n in (("all", k), ("unseen", 0), (f"own{k}", 2), (f"third{k % 3}", 1))]
    rows = lm.word_packs(spark.createDataFrame(held, "block int, word binary, n long").repartition(4)).collect()
    got = [(k, w, c) for r in rows if r.data for k, t in lm.unpacked(pa.record_batch({"block": [r.block], "data": [bytes(r.data)]})) for w, c in zip(t.column("word").to_pylist(), t.column("c").to_pylist())]
    count = lambda w, k: {"a": 435, "u": 0, "o": 2, "t": 10}[w[:1].decode()]
    assert sorted(got) == sorted((k, w, count(w, k)) for k, w, _ in held)
    total = lambda i: sum(r.n for r in rows if r.id == i)
    assert (total(lm.N_WORDS), total(lm.N_DISTINCT)) == (435 + 60 + 30, 1 + 30 + 3)
    assert "Join" not in lm.lm_scores(frame(spark, ROWS[:5]))._jdf.queryExecution().optimizedPlan().toString()


def test_lm_score_is_that_of_a_naive_model():
    s = small_scorer()
    texts = ["", "x", words(3, 5), words(4, 90), words(5, 200) + " 日本語 ñ", ROWS[12][1]]
    assert s.scores(texts) == pytest.approx([naive_score(s, t) for t in texts], rel=1e-4)
    assert s.scores(texts[::-1])[::-1] == pytest.approx(s.scores(texts), rel=1e-5)


def test_lm_segments_cover_every_text_in_the_end():
    """With a share of one, every position but the first after each cut is learned from; other shares take their part of all segments."""
    s = small_scorer()
    text = words(8, 500)
    every = np.vstack(s.segments(text, 5, 1))
    real = every[:, -lm.WINDOW :].astype(bool)
    got = every[:, lm.WINDOW : 2 * lm.WINDOW][real]
    assert set(got.tolist()) == set(s.ids([text])[0].tolist()) and len(got) >= len(s.ids([text])[0])
    n = [sum(map(len, s.segments(text, k, 8))) for k in range(200)]
    assert 0.6 < sum(n) / 200 / (len(every) / 8) < 1.6


def test_lm_learns_from_all_training_documents(spark):
    """The pass improves on the start, and its result doesn't depend on how rows are dealt to one worker."""
    import copy

    rows = [(i, words(i % 60, 120), None, None, 0) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    s = small_scorer()
    texts = [words(i, 120) for i in range(20)]
    before = s.scores(texts).sum()
    learned = lm.learn(d, copy.deepcopy(s), 3, 2)
    assert learned.scores(texts).sum() > before + 10
    assert lm.learn(d.where("false"), copy.deepcopy(s), 3, 2).scores(texts).sum() == pytest.approx(before)


def test_lm_weights_ignore_cores_and_partitions(spark):
    import copy

    rows = [(i if i % 9 else None, words(i % 50, 150)) for i in range(200)] + [(5, words(3, 40))] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string")
    s = small_scorer()
    one, two = (lm.learn(x, copy.deepcopy(s), 5) for x in (d.coalesce(1), d.repartition(7)))
    assert all(np.array_equal(one.model.p[k], two.model.p[k]) for k in s.model.p) and not np.array_equal(one.model.p["e"], s.model.p["e"])
    import pyarrow as pa

    packed = [(k, own) for r in lm.packed(d.repartition(3), 5).collect() for k, own in lm.unpacked(pa.record_batch({"block": [r.block], "data": [bytes(r.data)]}))]
    assert sorted(((i or -1), t) for _, own in packed for i, t in zip(own.column("doc_id").to_pylist(), own.column("text").to_pylist())) == sorted(((i or -1), t) for i, t in rows)
    assert {k for k, _ in packed} <= set(range(5))


def test_lm_windows_score_each_position_once():
    for n in (1, 31, 32, 33, 56, 57, 500):
        starts, first, room = lm.batch_windows(np.array([n, 3]))
        seen = [s + k for s, f, r in zip(starts, first, room) for k in range(f, min(lm.WINDOW, r))]
        assert sorted(seen) == list(range(n + 3))


def test_lm_is_a_distribution_and_causal():
    counts = np.random.default_rng(2).integers(0, 50, 400)
    v = lm.Vocabulary.of_counts(counts)
    assert np.allclose(np.bincount(v.class_of, 10**v.log_within, v.n_classes), 1)
    m = lm.Attention(v.n_classes)
    x = np.random.default_rng(3).integers(0, 50, (1, lm.WINDOW))
    a, _ = m.forward(x)
    assert np.allclose(a.sum(-1), 1, atol=1e-4)
    x2 = x.copy()
    x2[0, 20:] = 7
    b, _ = m.forward(x2)
    assert np.allclose(a[0, :20], b[0, :20], atol=1e-5) and not np.allclose(np.log(a[0, 20:]), np.log(b[0, 20:]), atol=1e-3)


def unfitted_scorer(texts: list[str]) -> lm.Scorer:
    plain = lm.Scorer(lm.Vocabulary.of_counts(np.ones(lm.vocabulary_size(lm.WORD_BPE) + 1, int)), lm.Attention(1))
    v = lm.Vocabulary.of_counts(sum(np.bincount(x, minlength=plain.end + 1) for x in plain.ids(texts)))
    return lm.Scorer(v, lm.Attention(v.n_classes, vocabulary=v))


def test_lm_learns_from_every_position(spark):
    """An embedding moves only if its id stands before a position that was learned from: all ids of all training texts do, wherever they stand."""
    import copy

    names = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work night point home water room mother area money story".split()
    rows = [(i, " ".join(["the"] * 150 + [w] + ["the"] * 450 + ["of", w, "of"] * 2)) for i, w in enumerate(names)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    s = unfitted_scorer([t for _, t in rows])
    before = s.model.p["e"].copy()
    learned = lm.learn(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), copy.deepcopy(s), 3)
    moved = set(np.flatnonzero((learned.model.p["e"] != before).any(1)).tolist())
    inputs = lambda texts: {int(e) for t in texts for e in s.vocabulary.embedding_of[s.ids([t])[0][:-1]]}
    assert 0 < len(held) < 12 and moved == inputs([t for i, t in rows if i not in held]) | {s.model.start}


def test_lm_learns_within_bounded_memory(spark):
    """A worker takes a few MB of text at a time and keeps a bounded number of words, however much its part holds."""
    rng = random.Random(7)
    rows = [(i, " ".join([f"{rng.getrandbits(40):x}" for _ in range(1200)] + ["the time"] * 5000)) for i in range(150)]
    plain = unfitted_scorer(["the time"])

    class Watched(lm.Scorer):
        def encoded(self, texts):
            import gc

            from chronosift.llm.common import Memo

            if texts.nbytes > 3 << 20:
                raise ValueError(f"{texts.nbytes} bytes of text at a time")
            out = super().encoded(texts)
            if (kept := sum(len(x) for x in gc.get_objects() if isinstance(x, Memo))) > 130_000:
                raise ValueError(f"{kept} words kept")
            return out

    s = Watched(plain.vocabulary, plain.model)
    before = s.model.p["e"].copy()
    learned = lm.learn(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), s, 1, 40)
    assert (learned.model.p["e"] != before).any()


def test_lm_encodes_each_text_once(spark):
    """Documents meet their words' ids once; learning reads those ids, in the same rows as when it encodes texts itself."""
    import copy

    import pyarrow as pa

    class Once(lm.Scorer):
        def encoded(self, texts):
            raise ValueError("a text is encoded again")

    rows = [(i, words(i % 50, 150) + f" own{i}" * (i % 3)) for i in range(150)] + [(200, None), (201, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    s = unfitted_scorer([t or "" for _, t in rows])
    blocks = lm.stored(lm.packed(d, 5), "test-texts")
    ids = lm.stored(lm.coded(lm.word_packs(lm.block_words(blocks)), blocks, 5, s.end, 1, 0.0), "test-ids")
    got = [x for r in ids.collect() for _, own in lm.unpacked(pa.record_batch({"block": [r.block], "data": [bytes(r.data)]})) for x in own.to_pylist()]
    assert sorted((x["doc_id"], x["ids"], x["n_tokens"]) for x in got) == [(i, s.ids([t or ""])[0].tolist(), len((t or "").split()) + 1) for i, t in rows]
    plain, learned = lm.learn(d, copy.deepcopy(s), 5), lm.learn_blocks(ids, Once(s.vocabulary, copy.deepcopy(s.model)), 5)
    assert all(np.array_equal(plain.model.p[k], learned.model.p[k]) for k in s.model.p) and not np.array_equal(learned.model.p["e"], s.model.p["e"])


def test_lm_windows_side_by_side():
    import pyarrow as pa

    lengths = np.array([1, 32, 33, 100])
    starts, room = lm.side_by_side(lengths)
    places = [p for s, r in zip(starts, room) for p in range(s, s + min(r, lm.WINDOW))]
    assert places == list(range(lengths.sum()))
    texts = ["", "A b  a", "\u00e9t\u00e9 " * 30, " x "]
    s = unfitted_scorer(texts)
    ids, n = s.encoded(pa.array(texts))
    assert n.tolist() == [len(x) for x in s.ids(texts)] and ids.tolist() == np.concatenate(s.ids(texts)).tolist()


def test_anchors_by_definition_without_a_search_per_window(monkeypatch):
    """Each window's leftmost gram of least hash, in runs; constant bytes tie everywhere. What is searched for is runs, not windows."""
    rng = random.Random(4)
    texts = [b"", b"x" * 49, b"x" * 300, words(1, 60).encode(), b"", b"ab" * 90, bytes(rng.choices(b"ab", k=700)), words(2, 8).encode(), b""]
    asked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more, **named: asked.append(np.size(v)) or search(a, v, *more, **named))
    a = suffix_dedup.Anchors(texts)
    assert sum(asked) <= len(a.at)
    value = {bytes(a.buf[p : p + 24]): h for p, h in zip(a.at.tolist(), a.hash.tolist())}
    got = {}
    for at, first, last, d in zip(a.at.tolist(), a.first.tolist(), a.last.tolist(), a.doc.tolist()):
        got |= {(d, w - int(a.begin[d])): at - int(a.begin[d]) for w in range(first, last + 1)}
    assert sorted(got) == [(d, w) for d, t in enumerate(texts) for w in range(len(t) - 49)]
    for (d, w), at in got.items():
        grams = [texts[d][p : p + 24] for p in range(w, w + 27)]
        known = [value.get(g, 1 << 64) for g in grams]  # anchors have the least hashes; others' are larger within the window
        assert at - w == known.index(min(known))


def test_lm_gradients():
    m = lm.Attention(12)
    rng = np.random.default_rng(4)
    x, t = rng.integers(0, 40, (4, lm.WINDOW)), rng.integers(0, 12, (4, lm.WINDOW))
    w = np.ones(x.shape, np.float32)
    g, _ = m.gradients(x, t, w)

    def loss():
        out, _ = m.forward(x)
        return -np.log(np.take_along_axis(out, t[..., None], -1)).mean()

    for k in ("q", "k", "v", "o", "w1", "w2", "w3", "b", "pos"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        m.p[k][at] += 1e-2
        up = loss()
        m.p[k][at] -= 2e-2
        down = loss()
        m.p[k][at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(g[k][at], rel=0.1, abs=2e-4), k


def test_lm_tells_rare_ids_apart_by_context():
    """Two ids of one class, each after its own context: both levels are distributions and learn which one follows."""
    counts = np.full(400, 5)
    v = lm.Vocabulary.of_counts(counts)
    m = lm.Attention(v.n_classes, vocabulary=v)
    k = v.n_classes - 1
    a, b = v.order[v.edges[k]], v.order[v.edges[k] + 1]
    side = np.arange(64) % 2
    x = np.repeat(side[:, None], lm.WINDOW, 1)
    ids = np.where(x == 0, a, b)
    w = np.ones(x.shape, np.float32)
    rng = np.random.default_rng(6)
    m.p["u"] += rng.normal(0, 0.3, m.p["u"].shape).astype(np.float32)
    t = v.class_of[ids]
    g, du = m.gradients(x, t, w, ids)
    g["u"] = np.zeros_like(m.p["u"])
    for (lo, hi), part in du.items():
        g["u"][lo:hi] += part

    def loss():
        m.table = None
        y = m.body(x).reshape(-1, lm.DIM)
        return -(m.chosen(y, t.ravel()) + m.chosen_id(y, ids.ravel())).mean()

    for name in ("u", "q", "o", "w1", "pos"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        m.p[name][at] += 1e-2
        up = loss()
        m.p[name][at] -= 2e-2
        down = loss()
        m.p[name][at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(g[name][at], rel=0.1, abs=2e-4), name
    m.fit(x, t, w, passes=60, batch=16, rate=2e-2, ids=ids)
    y = m.body(x)[:, -1]
    every = np.arange(v.edges[k], v.edges[k + 1])
    p = np.exp([m.chosen_id(y[:2], np.array([i, i])) for i in v.order[every]])
    assert np.allclose(p.sum(0), 1, atol=1e-4)
    assert p[0, 0] > 0.8 > 0.2 > p[1, 0] and p[1, 1] > 0.8 > 0.2 > p[0, 1]


def odd(spark):
    """Repeated ids with other texts, rows without an id, copies among them, and columns that stages use themselves."""
    rows = [(1, words(60, 80)), (1, words(61, 80)), (2, words(61, 80)), (2, words(61, 80)), (None, words(62, 80)), (None, words(60, 80)), (3, None), (4, ""), (5, words(63, 4000)), (6, words(64, 80))]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("predicted", "score", "held_out", "kept", "component_id", "contaminated", "item_id", "keep_id", "text_sha256", "component", "node", "block", "key", "__other_")
    from pyspark.sql import functions as F

    return d.select("*", *[F.lit(7).alias(n) for n in names]).repartition(3)


def test_near_dedup_of_odd_ids(spark):
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(odd(spark)).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (None, None, True), (None, None, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True)], key=str)


def test_scores_of_odd_ids(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(odd(spark), labels).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    got = lm.lm_scores(odd(spark)).collect()
    assert len(got) == 10 and all(r.score < 0 and r.base_score < 0 for r in got)
    twins = [r.score for r in got if r.doc_id == 2]
    assert twins[0] == pytest.approx(twins[1])
    bench = spark.createDataFrame([(1, words(60, 80)), (2, None)], "item_id long, text string")
    got = [(r.doc_id, r.contaminated) for r in decontamination.contamination(odd(spark), bench).collect()]
    assert len(got) == 10 and sorted(got, key=str).count((1, True)) == 1 and (None, True) in got and (None, False) in got


def test_quality_scores_are_those_of_a_naive_network(spark):
    """Filter by filter and place by place, over chunks that cover the text; also beyond one flush."""
    net = quality.Net()
    p = {k: v.astype(float) for k, v in net.p.items()}

    def naive(text: str) -> float:
        chunks = quality.chunks_of(text.encode())
        high, mean = [], []
        for c in chunks:
            x = quality.FEATURES[c].astype(float)
            z = np.array([np.maximum(x[i : i + quality.WIDTH].ravel() @ p["w"] + p["b"], 0) for i in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STEP)])[: quality.POSITIONS]
            high.append(z.max(0))
            mean.append(z.mean(0))
        f = np.concatenate([np.mean(high, 0), np.mean(mean, 0), np.max(high, 0)])
        return 1 / (1 + np.exp(-(np.tanh(f @ p["u"] + p["c"]) @ p["v"] + p["d"][0])))

    texts = ["", "x", words(1, 30), junk(3), words(2, 400), "日本語 ñ " * 50]
    assert net.scores(texts) == pytest.approx([naive(t) for t in texts], rel=1e-3)
    long = words(9, 1000) * 150
    assert len(quality.chunks_of(long.encode())) > 4096
    whole = net.pooled(quality.chunks_of(long.encode())).astype(float)
    f = np.concatenate([whole.mean(0), whole[:, : quality.FILTERS].max(0)])
    assert net.scores([words(1, 5), long])[1] == pytest.approx(1 / (1 + np.exp(-net.head(f)[1])), rel=1e-3)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Clashing columns, repeated and missing ids, null and empty texts, and no rows at all."""
    import corpus_pipeline as P

    d = f"file://{tmp_path}"
    spark.createDataFrame([(99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, words(64, 80))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    have = odd(spark)
    columns = have.columns
    for _, stage in P.STAGES[:-1]:
        have = stage(spark, have, d).cache()
        assert have.columns == columns
    got = sorted((str(r.doc_id) for r in have.select("doc_id").collect()))
    # text 61 goes with id 1, the copy of text 60 with the rows that have no id; one of the empty texts stays
    assert got == sorted(["1", "1", "None", "None", "3", "5"])
    for _, stage in P.STAGES:
        assert stage(spark, odd(spark).where("false"), d).count() == 0


def test_pipeline_by_hand(spark, tmp_path):
    """Each stage's decisions hold: what it drops is what its operator says."""
    import corpus_pipeline as P

    rows = [(i, junk(i) if i % 10 == 0 else words(i % 90, 80), "en", f"s{i % 3}", 1) for i in range(200)] + [(900, words(950, 10) + " " + words(777, 40) + " " + words(951, 10), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(777, 40))], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    d = f"file://{tmp_path}"
    have, at = docs, {}
    for name, stage in P.STAGES[:-1]:
        have = stage(spark, have, d).cache()
        assert have.columns == docs.columns
        at[name] = {r.doc_id for r in have.select("doc_id").collect()}
    clean = {i for i in range(200) if i % 10}
    assert len(clean - at["quality"]) <= 2 and 900 in at["quality"] and len(at["quality"] & {i for i in range(200) if i % 10 == 0}) <= 4
    by_text = {}
    for i, t, *_ in rows:
        if i in at["quality"]:
            by_text.setdefault(t, i)
    assert at["exact_dedup"] == set(by_text.values())
    near = near_components([r for r in rows if r[0] in at["exact_dedup"]])
    assert at["near_dedup"] == {i for i, v in near.items() if v[2]}
    assert at["decontamination"] == at["near_dedup"] - {900}
    assert {r.doc_id for r in P.run(spark, d).collect()} == at["decontamination"]
