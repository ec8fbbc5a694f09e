"""Token operators, secrets and exact dedup against the libraries, SQL and brute force."""

import random
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from chronosift.llm import exact_dedup, pieces, secrets, token_counts, token_files, tokens

from .helpers import corpus, empty, frame, words

TEXTS = {r[0]: r[1] or "" for r in corpus()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in corpus()])
    return c


def ids_of(text):
    return tokens.library(tokens.WORD_BPE).encode(text, add_special_tokens=False).ids


def test_token_counts(spark):
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark), limit=100).collect()}
    assert len(got) == len(TEXTS)
    for i, t in TEXTS.items():
        n = len(ids_of(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 100)
    assert token_counts.token_counts(empty(spark)).count() == 0


@pytest.mark.parametrize("i", [0, 9, 10, 12, 15, 16])
def test_every_prefix(i):
    text = TEXTS[i] + " x'll 'LLm i'm ΑΣ ﬁ İ 12ab²½ \x1c"
    table = token_counts.table_of(text)
    assert len(table) == len(text)
    want = [len(ids_of(text[: k + 1])) for k in range(len(text))]
    assert token_counts.counts_at(table).tolist() == want
    for budget in (0, 1, 5, 10**6):
        ok = [k + 1 for k, n in enumerate(want) if n <= budget]
        assert token_counts.longest_prefix(table, budget) == (max(ok) if ok else 0)


def test_encode_parts_chunks_at_any_white_space():
    """Chunks around line ends aren't looked up as chunks of their own, and ids are the library's."""
    from chronosift.llm import tokens
    from chronosift.llm.common import Memo

    text = "One end.\nTwo\tends\r\nthree\x0b\x0cof  it <|endoftext|> it's\u00a0\u00e9t\u00e9\x1c\n"
    library = tokens.chunk_ids(tokens.WORD_BPE)
    memo = Memo(library.__getitem__)
    ids = np.frombuffer(tokens.encode(text, memo), "<u4").tolist()
    assert ids == tokens.library(tokens.WORD_BPE).encode(text, add_special_tokens=False).ids
    assert {"One", "end.", "Two", "ends", "three", "of", "it"} <= set(memo) and not any(c in chunk for chunk in memo for c in " \t\n\x0b\x0c\r")


def test_token_file_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    got = {r.doc_id: r for r in token_files.round_trip(frame(spark), path).collect()}
    at = 0
    for i in sorted(TEXTS):
        ids = [*ids_of(TEXTS[i]), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.ids_of(spark, path, 9) == [*ids_of(TEXTS[9]), 2]
    assert token_files.round_trip(empty(spark)).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 777, dtype=np.uint64).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-777 * bits // 8)
    assert (token_files.unpack(data, bits, 0, 777) == ids).all()
    assert (token_files.unpack(data, bits, 501, 33) == ids[501:534]).all()


def test_pieces(spark):
    sp = pieces.pieces().sp
    got = {r.doc_id: r for r in pieces.encode_decode(frame(spark), full=False).collect()}
    for i, t in TEXTS.items():
        ids = sp.encode(t)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
        ends = [x.end for x in sp.encode(t, return_type="proto").pieces] if t else []
        assert got[i].spans_sha256 == hashlib.sha256(np.array(ends, "<u4").tobytes()).hexdigest()
    full = {r.doc_id: r for r in pieces.encode_decode(frame(spark)).collect()}
    assert full[12].ids == sp.encode(TEXTS[12]) and full[12].decoded == sp.decode(full[12].ids)
    assert pieces.encode_decode(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["  a  b ", " ", "▁x y", "日本 語 \x00 \U0001f600", "<s> <0x41>", "", "a   "])
def test_piece_spans(text):
    p = pieces.pieces()
    want = [(x.id, x.begin, x.end) for x in p.sp.encode(text, return_type="proto").pieces] if text else []
    assert p.spans(text) == want
    assert p.decode(p.sp.encode(text)) == p.sp.decode(p.sp.encode(text))


def charmap(rules: dict[bytes, bytes]) -> bytes:
    """A compiled character map by first-fit placement."""
    strings, at = b"", {}
    for k, v in rules.items():
        at[k] = len(strings)
        strings += v + b"\0"
    units, taken = {0: 0}, {0}

    def place(prefix: bytes, node: int) -> None:
        children = sorted({k[len(prefix)] for k in rules if k.startswith(prefix) and len(k) > len(prefix)})
        labels = ([0] if prefix in rules else []) + children
        offset = 1
        while any((node ^ offset ^ c) in taken for c in labels):
            offset += 1
        assert offset < 1 << 21
        units[node] |= offset << 10
        for c in labels:
            taken.add(node ^ offset ^ c)
        if prefix in rules:
            units[node] |= 1 << 8
            units[node ^ offset] = (1 << 31) | at[prefix]
        for c in children:
            units[node ^ offset ^ c] = c
            place(prefix + bytes([c]), node ^ offset ^ c)

    place(b"", 0)
    array = np.zeros(max(units) + 300, "<u4")
    for k, v in units.items():
        array[k] = v
    return (4 * len(array)).to_bytes(4, "little") + array.tobytes() + strings


def test_longest_prefix_normalisation():
    m = pieces.CharacterMap(charmap({"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": b"YZ", "é".encode(): b""}))
    data = "aﬁabcabé!".encode()
    out, source = m.normalise(data)
    assert out == b"afiYZX!"
    assert source.tolist() == [0, 1, 1, 4, 4, 7, 11, 12]


def brute_spans(text):
    found = []
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
    for k, (name, p, group, least) in enumerate((("assign", assign, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))):
        found += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in p.finditer(text) if len(m.group(group)) >= least]
    return ",".join(s for _, _, s in sorted(found))


def test_secrets(spark, con):
    got = {r.doc_id: r for r in secrets.secret_report(frame(spark)).collect()}
    for i, t in TEXTS.items():
        assert got[i].base_sha256 == hashlib.sha256(brute_spans(t).encode()).hexdigest(), t[:60]
    assert got[15].n_assign == got[15].n_access == got[15].n_hex == 1
    r = con.execute(secrets.OP6_SQL)
    cols = [c[0] for c in r.description]
    assert {x[0]: x for x in r.fetchall()} == {i: tuple(getattr(g, c) for c in cols) for i, g in got.items()}
    assert secrets.secret_report(empty(spark)).count() == 0


def odd_ids(spark):
    rows = [(None, "AKIA" + "A" * 16), (None, "token=abcdef"), (7, "AKIA" + "B" * 20), (7, "plain words"), (8, "secret: abcdefg " * 3), (9, "x" * 200_000 + " " + "0a" * 20)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 found", "2 mask0", "3 hit_id", "4 low", "5 part", "6 n_chars", "7 batch").repartition(3)


def test_odd_ids(spark, tmp_path):
    """Rows without an id, rows that share one, a long text, and clashing columns."""
    got = sorted(tuple(r)[:4] for r in secrets.secret_report(odd_ids(spark)).where("doc_id is not null").collect())
    assert got == [(7, 0, 0, 0), (7, 0, 1, 0), (8, 3, 0, 0), (9, 0, 0, 1)]
    assert sorted((r.n_assign, r.n_access) for r in secrets.secret_report(odd_ids(spark)).where("doc_id is null").collect()) == [(0, 1), (1, 0)]
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in odd_ids(spark).collect()))
    path = f"file://{tmp_path}/odd"
    token_files.write(odd_ids(spark), path, parts=2)
    rows = token_files.read(spark, path).orderBy("start").collect()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == [x[:2] for x in texts]
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array([*ids_of(x[2]), 2], "<u4").tobytes()) for x in texts]
    for f in (token_counts.token_counts, pieces.encode_decode):
        assert f(odd_ids(spark)).count() == 6
    d = exact_dedup.dedup(odd_ids(spark)).collect()
    assert len(d) == 6 and all(r.kept and r.group_size == 1 for r in d)


def test_token_file_of_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    path = f"file://{tmp_path}/many"
    token_files.write(frame(spark), path, parts=1)
    assert spark.read.parquet(path).count() > 3
    rows = token_files.read(spark, path).orderBy("start").collect()
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    assert all(token_files.ids_of(spark, path, i) == [*ids_of(TEXTS[i]), 2] for i in (0, 12, 17))


def test_more_trigrams_than_a_word_has_bits(spark):
    r = secrets.BASE + (secrets.Rule("long", "".join(chr(97 + i % 26) + str(i) for i in range(40))),)
    d = spark.createDataFrame([(1, "a " + "".join(chr(97 + i % 26) + str(i) for i in range(40))), (2, "a0b1c2"), (3, "AKIA" + "A" * 16)], "doc_id long, text string")
    got = {x.doc_id: x for x in secrets.secret_report(d, r).collect()}
    assert got[1].spans.startswith("long:2:") and got[2].spans == "" and got[3].n_access == 1


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abcd") == frozenset([frozenset(["abc", "bcd"])])
    assert q("[0-9]+") == frozenset([frozenset()])
    assert q("(abc|xyz)[0-9]") == frozenset([frozenset(["abc"]), frozenset(["xyz"])])
    assert q("ab?cd") == frozenset([frozenset(["abc", "bcd"]), frozenset(["acd"])])


def test_exact_dedup(spark, con):
    got = sorted(tuple(r) for r in exact_dedup.dedup(frame(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == sorted(con.execute(exact_dedup.OP8_SQL).fetchall())
    assert exact_dedup.dedup(empty(spark)).count() == 0


def test_index_is_kept_over_calls_and_sized(spark):
    index = exact_dedup.DigestIndex(spark, rows=exact_dedup.BUCKET_ROWS * 9 + 1)
    assert index.buckets == 10 and exact_dedup.DigestIndex(spark, index.path, index.name).buckets == 10
    before = spark.sql("show tables").count()
    exact_dedup.dedup(frame(spark)).collect()
    assert spark.sql("show tables").count() == before
    index.drop()


def test_index_grows(spark):
    index = exact_dedup.DigestIndex(spark)
    rows = corpus()
    exact_dedup.dedup(frame(spark, rows[:8]), index).collect()
    n = index.rows().count()
    later = {r.doc_id: r for r in exact_dedup.dedup(frame(spark, rows[3:]), index).collect()}
    assert later[3].kept is False and later[3].keep_id == 5 - 2  # the first batch's row
    assert later[10].kept is True and later[9].keep_id == 10
    assert index.rows().count() == n + len({r.text_sha256 for r in later.values() if r.kept})


def test_index_is_opened_again_by_its_path(spark, tmp_path):
    """As another session does, whose catalog doesn't know the table."""
    path = f"file://{tmp_path}/index"
    rows = [(i, words(i, 9), None, None, 0) for i in range(400)]
    first = exact_dedup.DigestIndex(spark, path, buckets=32)
    exact_dedup.dedup(frame(spark, rows), first).collect()
    first.drop()
    again = exact_dedup.DigestIndex(spark, path)
    assert again.buckets == 32 and again.rows().count() == 400
    assert exact_dedup.dedup(frame(spark, rows), again).where("kept").count() == 0
    assert again.rows().count() == 400
    again.drop()
    with pytest.raises(ValueError, match="32 buckets"):
        exact_dedup.DigestIndex(spark, path, buckets=8)
    os.remove(f"{tmp_path}/index.buckets")
    with pytest.raises(ValueError, match="has data"):
        exact_dedup.DigestIndex(spark, path)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in names if re.match(r"op\d", x)}


def test_prefix_counts_follow_composition_and_special_strings():
    from chronosift.llm.tokens import WORD_BPE, PrefixCounts

    rng = random.Random(4)
    parts = ["a", "e", "s", "t", "r", "l", "'", "É", "é", "e", "̂", "̣", "q̈", "中", "文", "漢", "Å", "İ", "ς", "1", "٣", "-", "<", "|", ">", " ", "　",
             "가", "ᄀ", "ᅡ", "ᆨ", "<|endoftext|>", "<|startof", "'re", "'ll", "\U0001f600", "ཱི", "क़", "ে", "া"]
    of = PrefixCounts(WORD_BPE)
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert of._followed(text) == of._by_library(text), ascii(text)


def test_prefix_counts_of_a_long_chunk_that_composes_call_the_library_once(monkeypatch):
    from chronosift.llm.tokens import WORD_BPE, PrefixCounts, library

    of = PrefixCounts(WORD_BPE)
    monkeypatch.setattr(of, "_by_library", None)
    text = "中文éx" * 5000
    table = of.of_chunk(text)
    assert sum(x - 256 * (x > 127) for x in table) == len(library(WORD_BPE).encode(text, add_special_tokens=False).ids)


def test_words_in_arrow_are_those_of_python():
    import pyarrow as pa

    from chronosift.llm import lm

    texts = ["", " ", "a  b\tC\n", "\x0b x\x0cÄy z\r", "ab", "\x85q   r\x1cs", "É A\x00b"]
    for a in (pa.array(texts), pa.array(["zz", *texts]).slice(1), pa.array([], pa.string()), pa.array(["", ""])):
        words, n = lm.words_in(a)
        each = [lm.words_of(x) for x in a.to_pylist()]
        assert words.to_pylist() == [w for x in each for w in x] and n.tolist() == [*map(len, each)]
