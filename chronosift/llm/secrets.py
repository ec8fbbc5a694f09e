"""Secret scan by a trigram index, on built-in functions only.

From each rule's regular expression a Boolean query over trigrams is derived
that every match satisfies: a conjunction over what must stand in sequence, a
disjunction over alternatives. Postings (trigram, doc_id) hold the trigrams that
any rule asks for; intersecting them gives each rule's candidate documents, and
only those meet the regular expression. A rule without mandatory trigrams scans
all texts. Trigrams are those of the lower-cased text, so they hold for either
case.

Cases: null and empty texts have no spans; spans are code points, end
exclusive; repeated rows repeat their results (doc_id is taken as the key: rows
that share one are scanned if any of them is a candidate); further columns are
ignored; very long texts are scanned whole.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.llm.common import texts_of
from chronosift.session import stored


@dataclass(frozen=True)
class Rule:
    """`group`'s match must have `least` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


_QUOTE = "[\"']?"
#: The base kinds, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", f"({either_case('password|passwd|secret|token|api_?key')}){_QUOTE}\\x20*[:=]\\x20*{_QUOTE}([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
#: Further kinds: private key headers, tokens with a fixed prefix, web tokens.
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("prefixed", "(?:gh[pousr]_|glpat-|xox[abp]-)[A-Za-z0-9_-]{20,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

# ---- Boolean trigram queries: frozenset of conjunctions (frozensets of trigrams); {frozenset()} is "all documents" ----
_ALL = frozenset([frozenset()])
#: Strings of one part beyond this many are no longer spelt out.
_SPELT = 64


def _both(a: frozenset, b: frozenset) -> frozenset:
    return _least(frozenset(x | y for x in a for y in b))


def _least(q: frozenset) -> frozenset:
    """Without conjunctions that another one implies."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _needs(strings: set[str]) -> frozenset:
    """What a text has that contains one of the strings."""
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def trigram_query(pattern: str) -> frozenset:
    """Conjunctions of lower-case trigrams of which every match has one; the
    empty conjunction stands for all texts."""

    def walk(items) -> tuple[frozenset, set[str] | None]:
        """Query of what is not spelt out, and all strings it can be (None: many)."""
        query, run, exact = _ALL, {""}, True
        for op, arg in items:
            own: set[str] | None = None
            if op is sre.LITERAL:
                own = {chr(arg).lower()}
            elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len({chr(v).lower() for _, v in arg}) <= 8:
                own = {chr(v).lower() for _, v in arg}
            elif op is sre.SUBPATTERN:
                q, own = walk(arg[-1])
                query = _both(query, q)
            elif op is sre.BRANCH:
                got = [walk(x) for x in arg[1]]
                if all(s is not None for _, s in got):
                    own = set().union(*(s for _, s in got))
                else:
                    query = _both(query, _least(frozenset().union(*(q if s is None else _both(q, _needs(s)) for q, s in got))))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, body = arg
                q, s = walk(body)
                if (low, high) == (0, 1) and s is not None:
                    own = s | {""}
                elif low:
                    query = _both(query, q if s is None else _both(q, _needs(s)))
            elif op is sre.AT:
                own = {""}
            if own is not None and len(run) * len(own) <= _SPELT:
                run = {a + b for a in run for b in own}
                continue
            exact = False
            query = _both(query, _needs(run))
            run = own if own is not None else {""}
        if exact:
            return query, run
        return _both(query, _needs(run)), None

    q, s = walk(parser.parse(pattern))
    return q if s is None else _both(q, _needs(s))


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) for those trigrams that occur in the lower-cased text."""
    low = F.lower("text")
    # one pass lower-cases; each trigram is one search
    t = texts.select("doc_id", low.alias("low"))
    found = F.filter(F.array(*[F.when(F.contains("low", F.lit(x)), F.lit(i)) for i, x in enumerate(trigrams)]), lambda x: x.isNotNull())
    return t.select("doc_id", F.explode(found).alias("trigram"))


def candidates(posts: DataFrame, rules: dict[str, frozenset], trigrams: list[str]) -> DataFrame:
    """doc_id and one Boolean per rule: postings intersected by the rule's query."""
    # as many words of 62 bits as the trigrams need
    words = range(-(-len(trigrams) // 62))
    place = {t: divmod(i, 62) for i, t in enumerate(trigrams)}
    masks = posts.groupBy("doc_id").agg(F.lit(1).alias("one"), *[F.expr(f"bit_or(if(trigram div 62 = {w}, shiftleft(1L, trigram % 62), 0L))").alias(f"mask{w}") for w in words])

    def holds(q: frozenset) -> Column:
        out = F.lit(False)
        for c in sorted(q, key=sorted):
            all_of = F.lit(True)
            for w in words:
                if bits := sum(1 << place[t][1] for t in c if place[t][0] == w):
                    need = F.lit(bits).cast("long")
                    all_of = all_of & (F.col(f"mask{w}").bitwiseAND(need) == need)
            out = out | all_of
        return out

    got = masks.select("doc_id", *[holds(q).alias(k) for k, q in rules.items()])
    any_rule = F.lit(False)
    for k in rules:
        any_rule = any_rule | F.col(k)
    return got.where(any_rule)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of the rule's kept matches. Positions come
    from the lengths of what stands between the matches."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    sized = whole if not rule.group else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    zipped = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("len"), F.transform(sized, F.length).alias("size"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        begin = acc["at"] + z["gap"]
        end = begin + F.coalesce(z["len"], F.lit(0))
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(z["size"] >= max(rule.least, 1), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and `found`: array of (start, kind, end) sorted by start, then
    the rule's place."""
    t = texts_of(docs)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if frozenset() not in q}
    trigrams = sorted({x for q in indexed.values() for c in q for x in c})
    posts = stored(postings(t, trigrams), "postings", None)
    hits = candidates(posts, indexed, trigrams)
    # rows without a doc_id share their postings: each is verified on its own text
    hits = hits.withColumnRenamed("doc_id", "hit_id")
    joined = t.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for i, r in enumerate(rules):
        found = spans_of(F.col("text"), quick(r), i)
        parts.append(F.when(F.coalesce(F.col(r.kind), F.lit(False)), found).otherwise(empty) if r.kind in indexed else found)
    return joined.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def quick(rule: Rule) -> Rule:
    """The same kept matches by a pattern that finds fewer short ones: a match
    is a whole run of one class, so its least length can stand in the pattern."""
    if not rule.group and rule.least and rule.pattern.endswith("]+"):
        head = rule.pattern[: rule.pattern.rindex("[")]
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least - len(head)},}}", 0, rule.least)
    return rule


def listing(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    kinds = tuple(r.kind for r in rules)
    s = scan(docs, rules)
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    count = lambda i: F.size(F.filter("found", lambda x: x["kind"] == i)).cast("long")
    return s.select(
        "doc_id",
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
        F.sha2(listing(base, kinds), 256).alias("base_sha256"),
        listing(F.col("found"), kinds).alias("spans"),
    )


def _sql() -> str:
    """The same spans by DuckDB's regular expressions, without the index."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    columns, lists = [], []
    for i, r in enumerate(RULES):
        p = quote(r.pattern)
        columns.append(
            f"list_transform(string_split_regex(t, {p}), lambda x: length(x)) AS g{i}, list_transform(regexp_extract_all(t, {p}), lambda x: length(x)) AS w{i}, "
            f"list_transform(regexp_extract_all(t, {p}, {r.group}), lambda x: length(x)) AS s{i}"
        )
        start = f"CAST(list_sum(g{i}[1:j]) + coalesce(list_sum(w{i}[1:j-1]), 0) AS BIGINT)"
        lists.append(
            f"list_transform(list_filter(range(1, len(w{i}) + 1), lambda j: s{i}[j] >= {max(r.least, 1)}), "
            f"lambda j: {{'start': {start}, 'kind': {i}, 'stop': {start} + w{i}[j]}})"
        )
    names = "[" + ", ".join(quote(r.kind) for r in RULES) + "]"
    say = f"lambda x: {names}[x.kind + 1] || ':' || x.start || ':' || x.stop"
    counts = ", ".join(f"CAST(len(list_filter(f, lambda x: x.kind = {i})) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"""
WITH m AS (SELECT doc_id, {", ".join(columns)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
     a AS (SELECT doc_id, list_sort(list_concat({", ".join(lists)})) AS f FROM m)
SELECT doc_id, {counts},
       sha256(coalesce(array_to_string(list_transform(list_filter(f, lambda x: x.kind < {len(BASE)}), {say}), ','), '')) AS base_sha256,
       coalesce(array_to_string(list_transform(f, {say}), ','), '') AS spans
FROM a
"""


OP6_SQL = _sql()
