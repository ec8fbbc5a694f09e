"""Collocations: phrases that occur more often than their parts let expect.

Phrases are named hierarchically. Texts become blocks of bounded size whose
words are numbers of the block's own vocabulary. At each level a block's distinct
grams go, in arrays, to the range of all grams that they hash to; a range sums
the counts over all blocks, names the frequent grams and answers each block with
their ids. Adjacent ids are the next level's pairs. A pair's row keeps the ids of
the two grams it was made of, so its cuts and the grams it contains are found by
following parents, never by comparing strings. What moves is an entry of an
array per distinct gram of a block, not a row per word of the corpus; the number
of ranges follows the bytes of text, so a range has some two million entries
whatever the corpus, and the most frequent gram has one entry per block.

A gram that is frequent consists of frequent grams, so nothing is lost by naming
those alone. Blocks end anywhere in a text; a block begins with the words before
it that a gram can reach back to, which count as the block's own only where a
gram ends beyond them.

Cases: null text counts as empty and a null lang as `und`; empty texts have no
words; very long texts are cut at white space into chunks of bounded size, a
single word is never cut; ties rank by phrase in byte order; repeated rows count
each; doc_id is not looked at, so it may be missing or repeat; an empty table
gives no phrases; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronosift.llm.common import slices
from chronosift.session import remove, stored, work_path

#: Tokens of a block, bytes of text handled at a time, and bytes of text whose grams are one range.
BLOCK_TOKENS, CHUNK_BYTES, RANGE_BYTES = 1 << 19, 2 << 20, 24 << 20
#: Salts of the first ranking, so that a large language isn't ranked in one task alone.
SALTS = 64
ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to a-z, every end of a piece to a full stop.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ENDS, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(ENDS))
#: Stands in sequences for an end of a piece, and for a gram that isn't frequent.
NONE = -1
#: What a block writes: its sequence of numbers (own: where its own words begin); per range its grams in the order of
#: their numbers (words with their language, or the ids of two grams: long integers as bytes) and counts (integers as
#: bytes); the words of each language.
LEVEL = pa.schema([
    ("block", pa.int64()), ("own", pa.int32()), ("seq", pa.binary()), ("part", pa.int32()), ("word", pa.list_(pa.binary())), ("left", pa.binary()), ("right", pa.binary()), ("n", pa.binary()),
    ("lang", pa.string()), ("total", pa.int64()),
])
LEVEL_SQL = "block long, own int, seq binary, part int, word array<binary>, left binary, right binary, n binary, lang string, total long"
#: What a range writes: per block the ids of its grams (NONE where not frequent); without a block the frequent grams.
NAMED = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("ids", pa.binary()), ("id", pa.list_(pa.int64())), ("word", pa.list_(pa.binary())), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())), ("f", pa.list_(pa.int64()))])
NAMED_SQL = "block long, part int, ids binary, id array<long>, word array<binary>, left array<long>, right array<long>, f array<long>"


def chunks(text: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The text in parts of some `size` bytes, cut where a space or an end stands."""
    at = 0
    while len(text) - at > size:
        found = re.compile(rb"[ \t.,;:!?\n-\r]").search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    """One row; numpy arrays become lists."""
    return pa.record_batch([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def _shares(block: int, part: np.ndarray, n: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per range; entries are already in the order of ranges."""
    ends = np.flatnonzero(np.diff(part, append=-1)) + 1
    for a, e in zip([0, *ends.tolist()], ends.tolist()):
        own = {k: v[a:e] if k == "word" else v[a:e].tobytes() for k, v in columns.items()}
        yield _row(LEVEL, block=block, part=int(part[a]), n=n[a:e].astype(np.int32).tobytes(), **own)


def _numbered(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by range, and each entry's number in that order."""
    order = np.argsort(part, kind="stable")
    number = np.empty(len(part), np.int32)
    number[order] = np.arange(len(part), dtype=np.int32)
    return order, number


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class _Block:
    """Words of one block: a vocabulary of words with their language, and the sequence."""

    def __init__(self, reach: int, ranges: int):
        self.reach, self.ranges, self.known, self.parts, self.size, self.own = reach, ranges, {}, [], 0, 0

    def _at(self, word: bytes) -> int:
        return self.known.setdefault(word, len(self.known))

    def add(self, lang: bytes, tokens: list[bytes]) -> None:
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        # words have no spaces, so a space parts them from their language
        names = np.fromiter((NONE if w == b"." else self._at(w + b" " + lang) for w in words), np.int32, len(words))
        self.parts.append(names[coded.indices.to_numpy(zero_copy_only=False)])
        self.size += len(tokens)

    def close(self, number: int) -> Iterator[pa.RecordBatch]:
        """The block's rows; it goes on as the next block, with what that reaches back to."""
        seq = np.concatenate([*self.parts, np.zeros(0, np.int32)])
        words = np.array([*self.known, None], object)[:-1]
        tail = seq[len(seq) - min(self.reach, len(seq)) :]
        if len(words):
            mine = seq[self.own :]
            counts = np.bincount(mine[mine >= 0], minlength=len(words))
            totals: dict[bytes, int] = {}
            for w, n in zip(words, counts.tolist()):
                lang = w.partition(b" ")[2]
                totals[lang] = totals.get(lang, 0) + n
            for lang, n in totals.items():
                yield _row(LEVEL, lang=lang.decode(), total=n)
            part = np.fromiter((zlib.crc32(w) % self.ranges for w in words), np.int32, len(words))
            order, place = _numbered(part)
            yield from _shares(number, part[order], counts[order], word=words[order])
            numbers = np.where(seq < 0, NONE, place[seq]).astype(np.int32)
            yield _row(LEVEL, block=number, own=self.own, seq=numbers.tobytes())
        self.known, self.parts = {}, []
        for t in tail.tolist():
            self.parts.append(np.array([NONE if t < 0 else self._at(words[t])], np.int32))
        self.own, self.size = len(tail), len(tail)


def first_level(docs: DataFrame, longest: int, ranges: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """LEVEL rows of the words."""
    t = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        block = _Block(longest - 1, ranges)
        for s in slices(batches, size=CHUNK_BYTES):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(s.column("lang").to_pylist(), s.column("text").to_pylist()):
                by.setdefault(lang, []).append(text.encode())
            for lang, texts in by.items():
                short = [x for x in texts if len(x) <= CHUNK_BYTES]
                whole = [[b"\n".join(short)]] * bool(short) + [chunks(x) for x in texts if len(x) > CHUNK_BYTES]
                for parts in whole:
                    for part in parts:
                        tokens = part.translate(FOLD).replace(b".", b" . ").split()
                        for i in range(0, len(tokens), block_tokens):
                            block.add(lang.encode(), tokens[i : i + block_tokens])
                            if block.size >= block_tokens:
                                yield from block.close(number)
                                number += 1
                    block.add(lang.encode(), [b"."])
        yield from block.close(number)

    return t.mapInArrow(run, LEVEL_SQL)


def named_grams(level: DataFrame, least: int) -> DataFrame:
    """NAMED rows: a range adds up its grams' counts over all blocks."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, shares = key[0].as_py(), table.column("n").to_pylist()
        whole = lambda c, kind=np.int64: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        ends = np.cumsum([len(x) // 4 for x in shares]).tolist()
        n = whole("n", np.int32)
        words = table.column("word").null_count == 0
        if words:
            coded = table.column("word").combine_chunks().flatten().dictionary_encode()
            of = coded.indices.to_numpy()
        else:
            left, of_left = np.unique(whole("left"), return_inverse=True)
            right, of_right = np.unique(whole("right"), return_inverse=True)
            pairs, of = np.unique(of_left * len(right) + of_right, return_inverse=True)
        f = np.zeros(int(of.max(initial=-1)) + 1, np.int64)
        np.add.at(f, of, n)
        often = np.flatnonzero(f >= least)
        ids = np.full(len(f), NONE, np.int64)
        ids[often] = (part << 32) + np.arange(len(often))
        out = [_row(NAMED, block=b, part=part, ids=ids[of[a:e]].tobytes()) for b, a, e in zip(table.column("block").to_pylist(), [0, *ends], ends)]
        if words:
            made = {"word": coded.dictionary.take(pa.array(often)).to_pylist()}
        else:
            made = {"left": left[pairs[often] // len(right)], "right": right[pairs[often] % len(right)]}
        out.append(_row(NAMED, part=part, id=ids[often], f=f[often], **made))
        return pa.Table.from_batches(out, NAMED)

    return level.where("part IS NOT NULL").select("part", "block", "word", "left", "right", "n").groupBy("part").applyInArrow(run, NAMED_SQL)


def next_level(level: DataFrame, named: DataFrame, ranges: int, last: bool) -> DataFrame:
    """LEVEL rows of the grams one word longer, from the sequences of `level` and
    the ids that the ranges gave their numbers."""
    sequences = level.where("seq IS NOT NULL").select("block", "own", "seq")
    answers = named.where("block IS NOT NULL").select(F.col("block").alias("its_block"), "part", "ids")

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        block, own = key[0].as_py(), left.column("own")[0].as_py()
        ids = np.frombuffer(b"".join(right.sort_by("part").column("ids").to_pylist()), np.int64)
        seq = np.frombuffer(left.column("seq")[0].as_py(), np.int32)
        often = np.append(ids >= 0, False)  # NONE finds the last
        both = np.flatnonzero(often[seq[:-1]] & often[seq[1:]])
        a, b = seq[both].astype(np.int64), seq[both + 1].astype(np.int64)
        pairs, inverse = np.unique(a * len(ids) + b, return_inverse=True)
        # a pair ends with its second gram, whose last word must be the block's own
        counts = np.bincount(inverse[both + 1 >= own], minlength=len(pairs))
        first, second = ids[pairs // max(len(ids), 1)], ids[pairs % max(len(ids), 1)]
        part = (_mixed(first, second) % np.uint64(ranges)).astype(np.int32)
        order, place = _numbered(part)
        out = list(_shares(block, part[order], counts[order], left=first[order], right=second[order])) if len(pairs) else []
        if not last and len(pairs):
            new = np.full(len(seq) - 1, NONE, np.int32)
            new[both] = place[inverse]
            out.append(_row(LEVEL, block=block, own=max(own - 1, 0), seq=new.tobytes()))
        return pa.Table.from_batches(out, LEVEL)

    return sequences.groupBy("block").cogroup(answers.groupBy("its_block")).applyInArrow(run, LEVEL_SQL)


def phrase_tables(docs: DataFrame, longest: int = 3, least: int = 10, block_tokens: int = BLOCK_TOKENS, ranges: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """lang, n (occurrences of all words); and per number of words a table of the
    frequent phrases: id, lang, phrase, last (its last word), f, left, right (ids
    of the phrases without the last and without the first word), prefixes,
    suffixes (f of the first and last 1, 2, ... words)."""
    spark = docs.sparkSession
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(1, -(-size // RANGE_BYTES))
    paths = [work_path(spark, "phrase-words")]
    level = stored(first_level(docs, longest, ranges, block_tokens), "", path=paths[0])
    totals = stored(level.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("total").alias("n")), "word-totals")
    tables: list[DataFrame] = []
    for k in range(1, longest + 1):
        if k > 1:
            paths.append(work_path(spark, f"phrase-level-{k}"))
            level = stored(next_level(level, named, ranges, k == longest), "", path=paths[-1])  # noqa: F821
            for p in paths[:-1]:  # what the new level was made of has done its work
                remove(spark, p)
            paths = paths[-1:]
        paths.append(work_path(spark, f"phrase-names-{k}"))
        named = stored(named_grams(level, least), "", path=paths[-1])
        keys = ["word"] if k == 1 else ["left", "right"]
        grams = named.where("block IS NULL").select(F.explode(F.arrays_zip("id", "f", *keys)).alias("g")).select("g.*")
        own = F.array("f")
        if k == 1:
            word, at = F.decode("word", "utf-8"), F.instr(F.decode("word", "utf-8"), " ")
            grams = grams.select("id", "f", F.substring(word, F.lit(1), at - 1).alias("last"), F.substring(word, at + 1, F.length(word)).alias("lang"))
            made = grams.select("id", "lang", F.col("last").alias("phrase"), "last", "f", own.alias("prefixes"), own.alias("suffixes"))
        else:
            a = tables[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("__p"), F.col("prefixes").alias("__pre"))
            b = tables[-1].select(F.col("id").alias("right"), F.col("last"), F.col("suffixes").alias("__suf"))
            made = grams.join(a.hint("merge"), "left").join(b.hint("merge"), "right")
            made = made.select("id", "left", "right", "lang", F.concat_ws(" ", "__p", "last").alias("phrase"), "last", "f", F.concat("__pre", own).alias("prefixes"), F.concat("__suf", own).alias("suffixes"))
        tables.append(stored(made, f"phrases-{k}"))
    for p in paths:
        remove(spark, p)
    return totals, tables


def candidates(tables: list[DataFrame], inside: int = 50) -> DataFrame:
    """lang, phrase, words, a, l, r, score of the phrases of two and more words
    that no longer candidate with `inside` percent of their occurrences holds.

    A phrase one word longer has no fewer occurrences than any longer one
    around it and is a candidate if that is, so only children are looked at."""
    wide = lambda c: c.cast("decimal(20,0)")
    out = None
    for k, t in enumerate(tables[1:], 2):
        cuts = F.array(*[
            F.struct(
                F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * (CAST(f AS DECIMAL(15,0)) * CAST(f AS DECIMAL(15,0))) div (CAST(prefixes[{j - 1}] AS DECIMAL(15,0)) * CAST(suffixes[{k - j - 1}] AS DECIMAL(15,0)))").alias("score"),
                F.lit(j).alias("cut"), F.col("prefixes")[j - 1].alias("l"), F.col("suffixes")[k - j - 1].alias("r"),
            )
            for j in range(1, k)
        ])
        own = t.withColumn("best", F.array_min(cuts))
        if k < len(tables):
            children = tables[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("child"))
            own = own.join(children.groupBy("id").agg(F.max("child").alias("child")), "id", "left").where(F.coalesce(100 * wide(F.col("child")) < inside * wide(F.col("f")), F.lit(True)))
        own = own.select("lang", "phrase", F.lit(k).alias("words"), F.col("f").alias("a"), "best.l", "best.r", "best.score")
        out = own if out is None else out.unionByName(own)
    return out


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, block_tokens: int = BLOCK_TOKENS, ranges: int | None = None) -> DataFrame:
    """Each lang's first `top` phrases of 2 to `longest` words with `least`
    occurrences: lang, rank, phrase, a, l, r, n, score (millionths)."""
    if longest < 2:
        raise ValueError("phrases have two words at least")
    totals, tables = phrase_tables(docs, longest, least, block_tokens, ranges)
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    found = candidates(tables, inside).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    found = found.withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
f2 AS (
  SELECT lang, g[1] AS x, g[2] AS y, count(*) AS f
  FROM (SELECT lang, unnest([[w[i], w[i + 1]] FOR i IN range(1, len(w))]) AS g FROM w) GROUP BY ALL),
f3 AS (
  SELECT lang, g[1] AS x, g[2] AS y, g[3] AS z, count(*) AS f
  FROM (SELECT lang, unnest([[w[i], w[i + 1], w[i + 2]] FOR i IN range(1, len(w) - 1)]) AS g FROM w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
big AS (SELECT * FROM f3 WHERE f >= 10),
two AS (
  SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, l.f AS l, r.f AS r,
         (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score
  FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f1 r ON r.lang = c.lang AND r.x = c.y
  WHERE c.f >= 10
    AND NOT EXISTS (SELECT 1 FROM big b WHERE b.lang = c.lang AND b.x = c.x AND b.y = c.y AND 100 * b.f >= 50 * c.f)
    AND NOT EXISTS (SELECT 1 FROM big b WHERE b.lang = c.lang AND b.y = c.x AND b.z = c.y AND 100 * b.f >= 50 * c.f)),
cut AS (
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z AS phrase, c.f AS a,
         l1.f AS l1, r1.f AS r1, l2.f AS l2, r2.f AS r2,
         (1000000::HUGEINT * c.f * c.f) // (l1.f::HUGEINT * r1.f) AS s1, (1000000::HUGEINT * c.f * c.f) // (l2.f::HUGEINT * r2.f) AS s2
  FROM big c JOIN f1 l1 ON l1.lang = c.lang AND l1.x = c.x JOIN f2 r1 ON r1.lang = c.lang AND r1.x = c.y AND r1.y = c.z
             JOIN f2 l2 ON l2.lang = c.lang AND l2.x = c.x AND l2.y = c.y JOIN f1 r2 ON r2.lang = c.lang AND r2.x = c.z),
every AS (
  SELECT * FROM two
  UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cut),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
