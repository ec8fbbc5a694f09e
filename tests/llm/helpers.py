"""Small corpora with the awkward cases, and brute-force versions."""

from __future__ import annotations

import hashlib
import random

BASE = "SELECT doc_id, text FROM VALUES"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("ba", "ko", "ti", "ré", "su", "na", "The")) for _ in range(r.randint(1, 4))) for _ in range(n))


def corpus() -> list[tuple]:
    """doc_id, text, lang, source, n_chars: nulls, empties, ties, copies, near copies, short, long and odd texts."""
    a, b = words(1, 120), words(2, 90)
    near = a.split()
    near[60] = "changed"
    texts = [
        None, "", " \n\t", a, a, a.replace(" ", "\n"), " ".join(near), b, b.upper(), "one two three", "one  two\tthree", "x", "日本語 テキスト é́ ñ \U0001F600 <|endoftext|> don't",
        words(3, 3000), words(4, 200) + " " + a[:200], "password: hunter22 AKIA" + "A" * 16 + " " + "0123456789abcdef" * 2, "token=api_key=abc secret=token:abcdef", "aaaa " * 300,
    ]
    return [(i, t, None if i % 3 else "en", f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    """With columns whose names an operator may use itself."""
    d = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    from pyspark.sql import functions as F

    return d.withColumn("score", F.lit(1)).withColumn("sig", F.lit("x")).withColumn("block", F.lit("y")).withColumn("kept", F.lit("z")).repartition(3)


def empty(spark):
    return frame(spark).where("false")


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def near_components(rows: list[tuple]) -> dict[int, tuple]:
    sets = {r[0]: shingles(r[1]) for r in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def repeats(rows: list[tuple], span: int = 50) -> dict[int, tuple]:
    first: dict[bytes, int] = {}
    out = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mask = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if first.setdefault(b[p : p + span], i) < i:
                mask[p : p + span] = b"\1" * span
        kept = bytes(x for x, m in zip(b, mask) if not m)
        runs = sum(1 for p in range(len(b)) if mask[p] and (p == 0 or not mask[p - 1]))
        out[i] = (len(b), sum(mask), runs, hashlib.sha256(kept).hexdigest())
    return out


def edits_within(pattern: bytes, text: bytes) -> int:
    """Least edits with which the pattern occurs anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)
