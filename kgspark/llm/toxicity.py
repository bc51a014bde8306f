"""Toxicity: Levenshtein automata over a lexicon trie, and context windows that tell quotation from abuse."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm import simhash
from kgspark.llm.common import in_split, materialize

#: Marks that open or close a quotation, words that report speech, words that address the reader.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes term word phrase alleged reported replied".split())
ADDRESS = frozenset("you your you're youre u ur yourself".split())
EDGE = ".,;:!?\"'()[]{}|%&#<>-“”„«»‹›…"
FORGET = 400_000  # words remembered by a task at once; a memory bound, not a cut


def shorter(word: str, k: int) -> set[str]:
    """The word with up to k letters left out."""
    out = last = {word}
    for _ in range(k):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Lexicon:
    """Trie of weighted terms, searched with Levenshtein automata."""

    def __init__(self, terms: dict[str, float], innocent: frozenset[str] = frozenset()) -> None:
        self.terms, self.innocent = terms, innocent
        self.root: dict = {}
        # of k + 1 pieces of a term one survives k edits, moved by k places at most:
        # length of a word -> (place, length of a piece) -> pieces
        pieces: dict[int, dict[tuple[int, int], set[str]]] = {}
        # words k edits apart or less are equal after at most k deletions in each
        self.shortened: dict[int, set[str]] = {}
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            n, k = len(term), self.allowed(len(term))
            for length in range(n - k, n + k + 1):
                places = pieces.setdefault(length, {})
                for i in range(k + 1):
                    a, b = n * i // (k + 1), n * (i + 1) // (k + 1)
                    for at in range(max(0, a - k), min(length - (b - a), a + k) + 1):
                        places.setdefault((at, at + b - a), set()).add(term[a:b])
            self.shortened.setdefault(k, set()).update(shorter(term, k) if k else ())
        self.pieces = {length: [(a, b, x) for (a, b), x in places.items()] for length, places in pieces.items()}
        self.memo: dict[str, tuple[str, int] | None] = {}

    @staticmethod
    def allowed(length: int) -> int:
        """Edits that a term of this length may have, at any of its letters."""
        return 0 if length < 5 else 1 if length < 9 else 2

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within its allowed edits; heavier, then smaller term on ties."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > FORGET:
            self.memo.clear()
        got = None
        if word in self.terms:
            got = (word, 0)
        elif word not in self.innocent and any(word[a:b] in x for a, b, x in self.pieces.get(len(word), ())) and self._close(word):
            found: list[tuple[int, float, str]] = []
            self._walk(self.root, tuple(range(len(word) + 1)), word, found)
            if found:
                edits, _, term = min(found)
                got = (term, edits)
        self.memo[word] = got
        return got

    def _close(self, word: str) -> bool:
        """False only if no term is within its edits; decides how rarely the trie is walked, not what is found."""
        one, two = self.shortened.get(1), self.shortened.get(2)
        return bool(one and not one.isdisjoint(shorter(word, 1)) or two and len(word) >= 7 and not two.isdisjoint(shorter(word, 2)))

    def _walk(self, node: dict, row: tuple[int, ...], word: str, found: list) -> None:
        """One state of the automaton is a row of edit distances; the trie edge is its input."""
        for c, child in node.items():
            if c == "":
                if 0 < row[-1] <= self.allowed(len(child)):
                    found.append((row[-1], -self.terms[child], child))
                continue
            nxt = [row[0] + 1]
            for i, w in enumerate(word):
                nxt.append(min(nxt[i] + 1, row[i + 1] + 1, row[i] + (w != c)))
            if min(nxt) <= 2:
                self._walk(child, tuple(nxt), word, found)


FEATURES = 5


def features(text: str | None, lexicon: Lexicon, window: int = 6) -> tuple[list[float], int, int]:
    """(features, abusive hits, quoted hits) of a whole text."""
    x = [0.0] * FEATURES
    if not text:
        return x, 0, 0
    raw = text.lower().split()
    hits = []
    find = lexicon.find
    known = {w: m for w in set(raw) if (m := find(w.strip(EDGE)))}
    if known:
        hits = [(i, *known[w]) for i, w in enumerate(raw) if w in known]
    quoted = 0
    weight = misspelt = aimed = 0.0
    open_marks = None
    for i, term, edits in hits:
        if open_marks is None:
            open_marks = np.cumsum([sum(w.count(q) for q in QUOTES) for w in raw])
        lo, hi = max(0, i - window), min(len(raw), i + window + 1)
        near = [w.strip(EDGE) for w in raw[lo:hi]]
        before = open_marks[i - 1] - (open_marks[lo - 1] if lo else 0) if i else 0
        own = open_marks[i] - (open_marks[i - 1] if i else 0)
        after = open_marks[hi - 1] - open_marks[i]
        in_quotes = own >= 2 or (before + own > 0 and after + own > 0 and (before or raw[i][0] in QUOTES))
        reported = any(w in REPORTING for w in near)
        if in_quotes or reported:
            quoted += 1
            continue
        w = lexicon.terms[term]
        weight += w
        misspelt += w * (edits > 0)
        aimed += any(v in ADDRESS for v in near)
    exact = len(hits) - quoted
    x[0] = float(weight > 0)
    x[1] = math.log1p(weight)
    x[2] = math.log1p(aimed)
    x[3] = math.log1p(quoted)
    x[4] = misspelt / weight if weight else 0.0
    return x, exact, quoted


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Newton steps for logistic regression drawn towards prior; the last weight is the intercept, not drawn."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.append(prior, 0.0)
    hold = np.diag(np.append(np.full(len(prior), ridge), 1e-3))
    to = np.append(prior, 0.0)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (w - to) @ hold @ (w - to) / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + hold @ (w - to)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + hold, grad)
        # whole steps can run away from a minimum of this convex loss; halved ones cannot
        now = loss(w)
        while np.abs(step).max() >= 1e-8 and loss(w - step) > now:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: What a feature is worth before labels speak: a hit, its weight, its aim, a quoted hit, being misspelt.
PRIOR = np.array([2.0, 1.0, 0.5, 0.2, -0.3])
UNTOLD = -3.0  # log-odds of every text where no term tells toxic ones


class Model:
    def __init__(self, terms: dict[str, float], weights: np.ndarray, innocent: frozenset[str] = frozenset()) -> None:
        self.terms, self.weights, self.innocent = terms, weights, innocent

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 16_000, min_support: int = 5, least_odds: float = 3.0, beside: float = 0.65, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and weights from a bounded sample of the labelled rows.

    The sample is the most_rows labelled ids (half of them of each label, or
    all there are) that come first in a hash order; that many ids are broadcast
    to find their texts. Of near copies (simhash.similar_groups) one of each
    label is counted, else their words would pass for telling ones. A
    word's document counts by label give its log-odds. Of the words that reach
    least_odds, those make the lexicon that in at least min_support toxic
    documents have `beside` of the log-odds of the document's most telling word:
    words that only keep company with slurs fall behind them, however rare the
    slurs are;
    words near a term that clean documents of the
    sample use as well are not taken for misspellings of it. Rows with null ids or labels are not learnt from;
    without labels, or with too few for any term, the lexicon is empty and every
    score is the same, far under 0.5: nothing tells toxic documents, none is
    rejected.
    """
    usable = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(7), "doc_id")
    ids = usable.where("toxic = 1").orderBy(order, "doc_id").limit(most_rows // 2).unionByName(usable.where("toxic = 0").orderBy(order, "doc_id").limit(most_rows // 2)).collect()
    if not ids:
        return Model({}, np.append(PRIOR, UNTOLD))
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int")
    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = materialize(sample.withColumn("row", F.monotonically_increasing_id()), "sample")
    groups = simhash.similar_groups(sample.select("row", "text"), id_col="row").withColumnRenamed("doc_id", "row")
    first = F.struct("doc_id", F.xxhash64("text"))
    sample = sample.join(groups, "row").groupBy("component_id", "toxic").agg(F.min_by("text", first).alias("text")).persist()
    word = F.explode(F.array_distinct(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.btrim(w, F.lit(EDGE)))))
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    counted = sample.select("toxic", word.alias("word")).where("length(word) >= 3").groupBy("word").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    telling = materialize(counted.where(F.col("c1") >= min_support).withColumn("odds", odds).where(F.col("odds") >= least_odds), "telling")
    # as many rows at most as the bounded sample has words
    votes = sample.where("toxic = 1").select("component_id", word.alias("word")).join(telling, "word").withColumn("best", F.max("odds").over(W.partitionBy("component_id")))
    top = votes.where(F.col("odds") >= beside * F.col("best")).groupBy("word", "odds").agg(F.count("*").alias("n")).where(F.col("n") >= min_support).orderBy("word").collect()
    terms = {r.word: float(min(r.odds, 8.0)) for r in top}
    if not terms:
        sample.unpersist()
        return Model({}, np.append(PRIOR, UNTOLD))

    def misspelt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(terms)
        for b in batches:
            yield b[[(m := lexicon.find(w)) is not None and m[1] > 0 for w in b["word"]]]

    # words of the sample that a term is near to, but that clean documents use as well
    near = counted.withColumn("odds", odds).where(F.col("odds") < least_odds / 2).select("word").mapInPandas(misspelt, "word string")
    innocent = frozenset(r.word for r in near.collect())
    shared = spark.sparkContext.broadcast((terms, innocent))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(*shared.value)
        for b in batches:
            x = [features(t, lexicon)[0] for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "x": x})

    rows = sorted(sample.select("toxic", "text").mapInPandas(measure, "toxic int, x array<double>").collect(), key=lambda r: (r.toxic, r.x))
    sample.unpersist()
    x, y = np.array([r.x for r in rows]).reshape(-1, FEATURES), np.array([r.toxic for r in rows], dtype=float)
    return Model(terms, fit_logistic(x, y, PRIOR), innocent)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(*keep, doc_id, score, predicted, abusive_hits, quoted_hits), one row per input row, by the whole text.

    Null, empty and wordless texts have no hits and get the score of such a
    text; ids of any kind, null included, pass through; documents are not shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.weights, model.innocent))
    kept = docs.select(*(keep or []), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    from pyspark.sql import types as T

    schema = T.StructType([f for f in kept.schema if f.name not in ("_id", "_text")] + [T.StructField("_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("abusive_hits", T.LongType()), T.StructField("quoted_hits", T.LongType())])

    def run(batches):
        import pyarrow as pa

        terms, weights, innocent = shared.value
        lexicon, m = Lexicon(terms, innocent), Model(terms, weights)
        for b in batches:
            got = [features(t, lexicon) for t in b.column("_text").to_pylist()]
            s = m.scores(np.array([g[0] for g in got]).reshape(-1, FEATURES))
            cols = [b.column(i) for i, name in enumerate(b.schema.names) if name not in ("_id", "_text")] + [b.column("_id"), pa.array(s, pa.float64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    out = kept.mapInArrow(run, schema).withColumnRenamed("_id", "doc_id") if "doc_id" not in (keep or []) else kept.mapInArrow(run, schema).drop("_id")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def training_labels(labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    return labels.where(~in_split(F.col("doc_id"), modulus, remainder))
