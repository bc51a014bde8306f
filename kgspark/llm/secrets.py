"""Secret scans through a trigram inverted index, in DataFrame functions only."""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import materialize


@dataclass(frozen=True)
class Rule:
    """kind, pattern (group: the part that min_length counts), least length."""

    kind: str
    pattern: str
    group: int
    min_length: int
    base: bool = True


#: The base rules in the order of their kinds, then rules that add spans.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so shorter ones need not be found and dropped
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, False),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39, False),
)

MOST_STRINGS = 200
SPANS = 512  # matches of a text whose places are summed in one go


def _strings(op, arg) -> set[str] | None:
    """All strings that a piece of a pattern can match, case folded; None if too many to list."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        out: set[str] = set()
        for kind, v in arg:
            if str(kind) == "LITERAL":
                out.add(chr(v).lower())
            elif str(kind) == "RANGE" and v[1] - v[0] < 8:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if name == "SUBPATTERN":
        return _sequence_strings(arg[3])
    if name == "BRANCH":
        parts = [_sequence_strings(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
        inner = _sequence_strings(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        more = _strings(op, arg)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """Boolean query that every match satisfies: all clauses, of each one alternative, of that all trigrams.

    Pieces that can be listed are multiplied out into runs; where a piece
    cannot, the run ends and gives a clause, if all its strings have three
    characters. An empty list: the rule has no mandatory trigrams.
    """
    clauses: list[frozenset[frozenset[str]]] = []
    run = {""}

    def end() -> None:
        if all(len(s) >= 3 for s in run):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append(frozenset(s for s in sets if not any(t < s for t in sets)))

    def walk(items) -> None:
        nonlocal run
        for op, arg in items:
            more = _strings(op, arg)
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            end()
            run = {""}
            if more is not None:
                run = more
            elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                walk(arg[2])
                end()
                run = {""}
            elif str(op) == "SUBPATTERN":
                walk(arg[3])

    walk(sre.parse(pattern))
    end()
    return clauses


def build_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, doc): one row per trigram of the rules and document that holds it, ASCII case folded.

    Only trigrams that some rule asks for are indexed; a posting list is rows,
    not an array, so a trigram of every document fills no single task.
    """
    folded = F.lower(F.col(text_col))
    found = F.filter(F.array(*[F.when(F.contains(folded, F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return docs.select(F.explode(found).alias("trigram"), _key(id_col).alias("doc"))


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[frozenset[str]]]]) -> DataFrame:
    """(doc, kinds): rules whose Boolean query the document's postings satisfy."""
    spark = postings.sparkSession
    rows = [(t, kind, c, a, len(alt)) for kind, clauses in queries.items() for c, clause in enumerate(clauses) for a, alt in enumerate(sorted(map(sorted, clause))) for t in alt]
    asked = spark.createDataFrame(rows, "trigram string, kind string, clause int, alternative int, n int")
    sizes = spark.createDataFrame([(k, len(c)) for k, c in queries.items() if c], "kind string, clauses int")
    # both have a row for each trigram or rule, whatever the documents
    met = postings.distinct().join(F.broadcast(asked), "trigram").groupBy("doc", "kind", "clause", "alternative").agg(F.count("*").alias("got"), F.first("n").alias("n")).where("got = n")
    whole = met.groupBy("doc", "kind").agg(F.count_distinct("clause").alias("got")).join(F.broadcast(sizes), "kind").where("got = clauses")
    return whole.groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


def _once(value: Column, f) -> Column:
    """f(value), with value computed once a row however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, stop>> of a rule's matches in code points, leftmost first, short ones dropped."""
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("len"), F.transform(counted, F.length).alias("counted"))
    wide = lambda x: (F.coalesce(x["gap"], F.lit(0)) + F.coalesce(x["len"], F.lit(0))).cast("long")
    zero, ends = F.lit(0).cast("long"), F.array().cast("array<long>")
    # running sums over blocks of matches, and inside each block: appending to one long array would take quadratic time
    blocks = _once(steps, lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / SPANS).cast("int")), lambda k: F.slice(all_, k * SPANS + 1, F.lit(SPANS))))
    upto = lambda xs: F.aggregate(xs, F.array(zero), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    starts_of = lambda bs: upto(F.transform(bs, lambda xs: F.aggregate(xs, zero, lambda n, x: n + wide(x))))

    def spans(xs: Column, at: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            return F.struct((acc["at"] + wide(x)).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + wide(x))).alias("ends"))

        ended = F.aggregate(xs, F.struct(at.alias("at"), ends.alias("ends")), add, lambda acc: acc["ends"])
        return F.zip_with(xs, ended, lambda x, e: F.struct((e - x["len"]).cast("long").alias("start"), F.lit(rank).alias("rank"), e.alias("stop"), x["counted"].alias("counted")))

    every = F.flatten(_once(blocks, lambda bs: F.zip_with(bs, F.slice(starts_of(bs), F.lit(1), F.size(bs)), spans)))
    # the last gap has no match and no length
    return F.transform(F.filter(every, lambda s: s["counted"] >= rule.min_length), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans array<struct<start,rank,stop>>): spans by start, then rule; one row per input row.

    Rules with mandatory trigrams are verified on their candidates only, the
    rest scan fully. Null texts count as empty; repeated rows and equal ids stay
    rows of their own; null ids stay null.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for c in queries.values() for clause in c for alt in clause for t in alt})
    postings = materialize(build_index(docs, trigrams, id_col, text_col), "postings")
    asked = candidates(postings, queries)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), _key(id_col).alias("doc"))
    joined = rows.join(asked, "doc", "left")
    none = F.array().cast("array<struct<start:long,rank:int,stop:long>>")
    per_rule = []
    for rank, r in enumerate(rules):
        test = F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), r.kind) if queries[r.kind] else F.lit(True)
        per_rule.append(F.when(test & F.col("text").rlike(r.pattern), spans_of(F.col("text"), r, rank)).otherwise(none))
    return joined.select("doc_id", "text", F.array_sort(F.concat(*per_rule)).alias("spans"))


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
