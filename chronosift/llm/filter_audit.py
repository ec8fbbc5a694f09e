"""How document filters interact: what each removes in every order.

Every document is reduced to a mask with one bit per filter that it fails, and
documents to cells (part, mask) with their numbers. Cells are unpivoted against
the steps of all orders; a running bit-or over the steps before tells which cells
are gone, conditional sums give a step's figures, and a total over the filter's
steps in all orders gives its Shapley sum. Only the cells' side grows with the
orders: rows are n! * n for each part and mask that occurs, whatever the corpus.

Cases: null text counts as empty (it fails the length filter, and every empty
text but the first is a copy), a null source is the part ''; very long texts are
read whole; equal texts are copies of the smallest doc_id, and rows that share
that smallest id are no copies; a row without a doc_id is neither a copy nor
makes others copies; several labels of one document count as the best of them,
labels without a doc_id are ignored; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronosift.llm.common import texts_of
from chronosift.session import stored

#: Separators of words, as a regular expression.
BETWEEN = r"[\x20\x09-\x0D]+"


def text_filters(text: str = "text") -> dict[str, Column]:
    """Letter -> condition of failing, from the text alone."""
    words = F.array_remove(F.split(text, BETWEEN), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 50,
        "B": 100 * distinct.cast("long") < 65 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": F.col(text).rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, copies: str = "E") -> tuple[DataFrame, str]:
    """Per row: doc_id, part, mask (bit i for the ith letter failed); and the letters.

    Texts are compared by SHA-256, and only digests move."""
    filters = text_filters()
    letters = "".join(filters) + copies
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    own = texts_of(docs, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask")
    )
    own = stored(own, "masks")
    first = own.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    first = stored(first, "first-of-copies")  # a table of its own, so that the join can split a digest of many rows
    copy = F.when(F.col("first_id") < F.col("doc_id"), 1 << len(filters)).otherwise(0)
    return own.join(first.hint("merge"), "digest", "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask")), letters


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of a cell, and those labelled so."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    return masks.join(known.hint("merge"), "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def interactions(cells: DataFrame, letters: str) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley. The number of orders is the
    factorial of the number of letters."""
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)]))
    bits = F.create_map(*[F.lit(x) for i, c in enumerate(letters) for x in (c, 1 << i)])
    steps = F.posexplode(F.transform(F.split("filter_order", ""), lambda x: bits[x]))
    long = cells.withColumn("filter_order", orders).select("*", steps.alias("at", "bit"))
    over = W.partitionBy("part", "filter_order", "mask").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.coalesce(F.bit_or(F.col("mask").bitwiseAND(F.col("bit"))).over(over), F.lit(0))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("earlier") != 0
    here = fails & ~gone
    total = lambda cond, what="n": F.sum(F.when(cond, F.col(what)).otherwise(0)).alias
    out = long.withColumn("earlier", earlier).groupBy("part", "filter_order", "at", "bit").agg(
        total(~fails & ~gone)("kept"), total(here)("removed"), total(fails & gone)("redundant"), total(F.col("mask") == F.col("bit"))("unique_fails"),
        total(here, "good")("good_lost"), total(here, "toxic")("toxic_lost"),
    )
    shapley = F.sum("removed").over(W.partitionBy("part", "bit"))
    figures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return out.select("part", "filter_order", (F.col("at") + 1).alias("step"), *figures, shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of all filters over docs (doc_id, text, source) and labels (doc_id, quality, toxic)."""
    masks, letters = failures(docs)
    return interactions(cells(masks, labels), letters)


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
m AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS mask
  FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step, CAST(1 << (instr('ABCDE', filter_order[step]) - 1) AS INTEGER) AS bit,
         list_sum([1 << (instr('ABCDE', filter_order[k]) - 1) FOR k IN range(1, step)])::INTEGER AS before
  FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step)),
g AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM g
"""
