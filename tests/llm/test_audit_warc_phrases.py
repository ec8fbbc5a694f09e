"""Collocations, filter interactions and archives against brute force and SQL."""

import gzip
import hashlib
import itertools
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from chronosift.llm import filter_audit, phrases, queries, warc

from .helpers import corpus, empty, frame, words

DATA = "/root/testdata/sf0.001"


def small_corpus():
    """With pieces, tabs, ties, copies, long texts without an end, words of other scripts, null and odd languages."""
    texts = [t for _, t, *_ in corpus()]
    texts += ["New York City. new york city; NEW YORK\tCITY!  new york"] * 12 + ["a b a b a b a b a b a b a b a b", "x y z\nx y\rz x\x0by z x y z"] * 6
    texts += ["größe ÄPFEL größe ÄPFEL x größe ÄPFEL"] * 7 + ["tic tac toe " * 40, "tic tac " * 9, "." * 30, " , ; ", words(8, 400) * 2]
    return [(i, t, (None, "en", "de", "")[i % 4] if i < 30 else "en", "s", 0) for i, t in enumerate(texts)]


def counted(rows, longest):
    grams = {}
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                grams.setdefault("und" if lang is None else lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return grams


def brute_phrases(rows, longest=3, least=10, inside=50, top=2000):
    out = {}
    for lang, f in counted(rows, longest).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cand = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        held = lambda g, h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        found = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= inside * a and held(g, h) for h, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out[lang, rank] = (p.decode(), -a, left, right, n, -s)
    return out


def as_dict(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("tokens,ranges", [(phrases.BLOCK_TOKENS, None), (37, 3), (5, 1), (2, 7)])
def test_collocations(spark, tokens, ranges):
    """Blocks of a few words must count what reaches over their ends."""
    rows = small_corpus()
    want = brute_phrases(rows)
    assert len(want) > 10 and {len(v[0].split(" ")) for v in want.values()} == {2, 3}
    assert as_dict(phrases.collocations(frame(spark, rows), block_tokens=tokens, ranges=ranges)) == want


def test_collocations_longer_and_fewer(spark):
    rows = small_corpus()
    assert as_dict(phrases.collocations(frame(spark, rows), longest=5, least=6, inside=80, top=9)) == brute_phrases(rows, 5, 6, 80, 9)
    assert as_dict(phrases.collocations(frame(spark, rows), longest=2)) == brute_phrases(rows, 2)
    assert phrases.collocations(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(frame(spark), longest=1)


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    text = ("one two three. four\tfive " * 50).encode() + b"x" * 500 + b" end"
    parts = list(phrases.chunks(text, 64))
    assert b"".join(parts) == text and len(parts) > 10 and all(p[:1] in b" \t." for p in parts[1:])
    rows = [(1, text.decode(), "en", "s", 0), (2, "y" * 300, None, "s", 0)]
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 64)
    got = Counter()
    for r in phrases.first_level(frame(spark, rows), 3, 2).where("word IS NOT NULL").collect():
        got.update(dict(zip(map(bytes, r.word), np.frombuffer(r.n, np.int32).tolist())))
    want = {g[0].encode() + b" en": c for g, c in counted(rows, 1)["en"].items()} | {b"y" * 300 + b" und": 1}
    assert +got == Counter(want)


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    one = lambda i, p, f: (i, "en", p, p, f, [f], [f])
    t1 = spark.createDataFrame([one(0, "a", big), one(1, "b", big + 1)], "id long, lang string, phrase string, last string, f long, prefixes array<long>, suffixes array<long>")
    t2 = spark.createDataFrame([(5, 0, 1, "en", "a b", "b", big - 7, [big, big - 7], [big + 1, big - 7])], "id long, left long, right long, lang string, phrase string, last string, f long, prefixes array<long>, suffixes array<long>")
    r = phrases.candidates([t1, t2]).first()
    assert r.score == 10**6 * (big - 7) ** 2 // (big * (big + 1)) and (r.l, r.r) == (big, big + 1)


def brute_audit(rows, labels):
    fails = {}
    for i, text, _, source, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = min((r[0] for r in rows if (r[1] or "") == t and r[0] is not None), default=None)
        fails.setdefault(source or "", []).append(("".join(c for c, x in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and first < i)) if x), i))
    out = {}
    for part, docs in fails.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, c in enumerate(order, 1):
                gone = [d for d in left if c in d[0]]
                left = [d for d in left if c not in d[0]]
                red = sum(c in d[0] for d in docs) - len(gone)
                label = lambda k: sum(labels.get(d[1], (0, 0))[k] == 1 for d in gone)  # noqa: E731, B023
                out[part, "".join(order), step] = [len(left), len(gone), red, sum(d[0] == c for d in docs), label(0), label(1)]
        for c in "ABCDE":
            of = [k for k in out if k[0] == part and k[1][k[2] - 1] == c]
            total = sum(out[k][1] for k in of)
            for k in of:
                out[k].append(total)
    return out


def audit_rows():
    rows = [(i, t, lang, (None, "", "s0", "s1")[i % 4], n) for i, t, lang, _, n in corpus()]
    more = [words(5, 60) + " A#B", words(5, 60) + " A#B", "UPPER CASE " * 30, "up to | " * 20, "", words(6, 80)]
    return rows + [(100 + i, t, "en", "s0", 0) for i, t in enumerate(more)] + [(102, "again", "en", "s1", 0), (102, "again", "en", "s1", 0), (None, "again", "en", "s1", 0)]


def test_filter_audit(spark):
    rows = audit_rows()
    marks = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 104, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    best = {}
    for i, q, t in marks:
        if i is not None:
            a, b = best.get(i, (0, 0))
            best[i] = (max(a, q or 0), max(b, t or 0))
    got = filter_audit.audit(frame(spark, rows).withColumn("mask", F.lit(1)).withColumn("n", F.lit(2)), labels)
    have = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()}
    assert have == brute_audit(rows, best)
    assert filter_audit.audit(empty(spark), labels).count() == 0


def test_interactions_of_other_filters(spark):
    c = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 0, 1), ("p", 3, 4, 1, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.interactions(c, "XY").collect()}
    assert got == {("XY", 1): (5, 6, 0, 2, 8), ("XY", 2): (5, 0, 4, 0, 4), ("YX", 1): (7, 4, 0, 0, 4), ("YX", 2): (5, 2, 4, 2, 8)}


PAGES = "page_id long, url string, html string"


def pages():
    a, b = "<p>" + "é" * 60 + "</p>\r\n\r\nx", "<html>" + words(3, 2000)
    rows = [
        (5, "http://x/a b\r\nc?é", a), (2, "http://x/", a), (9, None, a), (None, "http://n/", a), (2, "http://twice/", a), (3, "", b), (4, "u", b), (6, "v", ""), (7, "v", None), (8, "w", "short"), (10, "w", "short"),
        (11, "z", "q" * 99), (12, "z", "q" * 99), (13, "z", "q" * 100), (14, "z", "q" * 100), (None, "n", "only" * 30), (None, "n", "only" * 30),
    ]
    return rows


def brute_warc(rows, least=100):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min((r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None), default=None)
        again = len(raw) >= least and first is not None and (i is None or i > first)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark, tmp_path):
    d = spark.createDataFrame(pages(), PAGES).withColumn("payload", F.lit(1)).withColumn("file", F.lit("x")).repartition(3)
    got = warc.round_trip(d, f"file://{tmp_path}/w")
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_warc(pages())
    assert warc.round_trip(d.where("false"), f"file://{tmp_path}/e").count() == 0


def test_warc_files_are_whole_archives(spark, tmp_path):
    """Every file is read from its beginning without the index."""
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame(pages(), PAGES).repartition(2), path, file_bytes=900)
    rows = {(r.file, r.offset): r for r in warc.index(spark, path).collect()}
    files = sorted(os.listdir(tmp_path / "w/data"))
    assert len(files) > 2 and len(rows) == len(pages()) and warc.unused_files(spark, path) == []
    for name in files:
        raw = (tmp_path / "w/data" / name).read_bytes()
        ends = sorted(r.offset for r in rows.values() if r.file == name) + [len(raw)]
        types = []
        for a, b in zip([0, *ends], ends):
            headers, block = warc.parse(raw[a:b])
            types.append(headers["warc-type"])
            if a:
                r = rows[name, a]
                assert (headers["warc-type"], headers["warc-payload-digest"], r.length) == (r.record_type, "sha256:" + r.payload_digest, b - a)
                assert block.startswith(b"HTTP/1.1 200 OK\r\n") and "\r" not in headers.get("warc-target-uri", "")
        assert types[0] == "warcinfo" and set(types[1:]) <= {"response", "revisit"}
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == len(types)
    (tmp_path / "w/data/left.warc.gz").write_bytes(b"")
    assert [f.rpartition("/")[2] for f in warc.unused_files(spark, path)] == ["left.warc.gz"]


def test_selected_records_are_read_alone(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    rows = [(i, f"http://x/{i % 7}", f"{i} " + words(i, 40)) for i in range(60)]
    warc.write(spark.createDataFrame(rows, PAGES), path)
    picked = warc.index(spark, path).where("url = 'http://x/3'")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, path, picked).collect()}
    assert got == {i: h for i, _, h in rows if i % 7 == 3}
    r = picked.first()
    with pytest.raises(Exception, match="record"):
        warc.read(spark, path, picked.limit(1).withColumn("length", F.lit(r.length - 3))).collect()


def test_ranges_become_runs():
    assert warc.runs([(0, 10), (10, 5), (40, 5), (46, 100), (146, 5)], gap=8, most=60) == [(0, 2, 15), (2, 3, 45), (3, 4, 146), (4, 5, 151)]
    assert warc.runs([]) == [] and warc.runs([(7, 3)]) == [(0, 1, 10)]
    fs, path = warc._fs("file:///tmp/x")
    assert isinstance(fs, pafs.LocalFileSystem) and path == "/tmp/x"


@pytest.mark.parametrize("name", ["op11_collocations", "op12_filter_audit", "op13_warc"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = queries.queries()[name](spark, DATA)
    r = con.execute(queries.oracle_sql()[name])
    have = [c[0] for c in r.description]
    assert sorted(have) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*have).collect()))) == sorted(map(str, r.fetchall()))


