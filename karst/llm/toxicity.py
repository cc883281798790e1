"""Toxicity: a learnt lexicon, matched with misspellings, and scores of each hit's context."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.automaton import FuzzyLexicon, Term
from karst.llm.common import Workspace, let, table

THRESHOLD = 0.7
#: Labelled rows the lexicon and the weights are learnt from at most (smallest hashes of doc_id first).
TRAIN_ROWS = 12_000
#: Entries of the lexicon at most; all of it is broadcast.
MOST_TERMS = 4_000
#: Lengths of stems that are tried besides whole words.
STEMS = (3, 4, 5, 6, 7, 8, 9)
#: A term needs so many toxic documents and different neighbourhoods (copies of a text have the same ones) ...
LEAST_SUPPORT = 3
#: Chance that any form that has nothing to do with toxicity becomes a term.
FALSE_TERMS = 0.05
#: Weight of a toxic row's second copy, whose terms are misspelt: labels alone may hold no misspelling to learn from.
MISSPELT_WEIGHT = 0.3
#: ... and at most this share of clean ones.
MOST_CLEAN = 0.01
#: Words on either side of a hit that are its context.
WINDOW = 8
CACHE_ENTRIES = 1_000_000
#: Different ordinary words around a term from which on a word near it is no evidence of a misspelling.
CROWDED = 2

TOKEN = r"[\p{L}\p{N}*@$]+"
#: A mark at either end that hides a letter is left out: a missing letter is as far from the term as a wrong one.
_TOKEN = re.compile(r"[^\W_](?:[\w*@$]*[^\W_])?")
_OPEN = re.compile(r"(?:^|(?<=\s))[\"“«„‘]|[“«„]")
_CLOSE = re.compile(r"[\"”»’](?=\s|[.,;:!?]|$)|[”»]")
#: Words that report what somebody else said.
REPORTS = frozenset("said says say wrote writes quoted quote quotes called calls word words term terms insult slur reported dit disait écrit mot sagte sagt schrieb wort zitat dijo dice escribió palabra".split())

FEATURES = ("most_plain", "strength", "log_plain", "most_fuzzy", "log_fuzzy", "log_quoted")


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text leaves 1 by 3; a null doc_id has no such remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most `most` labelled documents that aren't held out."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # at most `most` rows


def significant(toxic: int, clean: int, share: float, forms: int) -> bool:
    """Whether so many toxic documents among those with a form can't be chance, where `share` of all are toxic and so
    many forms are tried: Chernoff's bound on the binomial tail, times the number of forms, is below FALSE_TERMS."""
    n = toxic + clean
    p = toxic / n
    if p <= share:
        return False
    far = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0)
    return n * far >= math.log(forms / FALSE_TERMS)


def learn_lexicon(work: Workspace, train: DataFrame) -> list[tuple[Term, float]]:
    """Whole words and stems that toxic documents have and clean ones don't, by more than chance, each in the form that
    covers most, and the log of its toxic documents over its clean ones. Near copies are one document."""
    sizes = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}  # two rows
    if not sizes.get(0) or not sizes.get(1):
        return []
    share = sizes[1] / (sizes[0] + sizes[1])
    tokens = F.filter(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)), lambda w: F.trim(w, F.lit("*@$"))), lambda w: w != "")
    sketch = let(F.col("w"), lambda w: F.array_min(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3)))))
    words = train.withColumn("w", tokens).select("toxic", "w", sketch.alias("sketch"))  # the least shingle: near copies mostly share it and count once
    forms = lambda w: F.concat(F.array(F.concat(w, F.lit("$"))), *[F.when(F.length(w) > n, F.array(F.substring(w, 1, n))).otherwise(F.array().cast("array<string>")) for n in STEMS])
    near = F.expr("transform(w, (x, i) -> struct(x as x, xxhash64(get(w, i - 1), get(w, i + 1)) as c))")
    toxic = words.where("toxic = 1").withColumn("near", near).select("sketch", F.explode_outer("near").alias("n")).where("n is not null")
    toxic = toxic.select("sketch", "n.c", F.explode_outer(forms(F.col("n.x"))).alias("form"))
    toxic = toxic.groupBy("form").agg(F.countDistinct("sketch").alias("docs"), F.countDistinct("c").alias("places")).where(F.least("docs", "places") >= LEAST_SUPPORT)
    clean = words.where("toxic = 0").select(F.explode_outer(F.array_distinct(F.flatten(F.transform("w", forms)))).alias("form")).where("form is not null")
    clean = clean.groupBy("form").agg(F.count("*").alias("clean"))
    found = work.keep(toxic.join(clean, "form", "left").withColumn("clean", F.coalesce("clean", F.lit(0))), "forms")
    few = F.col("clean") <= MOST_CLEAN * F.col("docs")
    forms_tried = found.count()
    rows = found.where(few).orderBy(F.desc("docs"), F.desc(F.length("form")), "form").limit(20 * MOST_TERMS).collect()
    rows = [r for r in rows if significant(min(r.docs, r.places), r.clean, share, forms_tried)]
    work.drop(found)
    clean_of = {r.form: r.clean for r in rows}
    terms = widest({r.form: r.docs for r in rows})[:MOST_TERMS]
    return [(t, float(np.log((n + 0.5) / (clean_of[f] + 0.5)))) for f, t, n in terms]


def widest(docs_of: dict[str, int]) -> list[tuple[str, Term, int]]:
    """Of forms one in another (a stem, longer stems, words: 'word$'), the widest, in its longest form of equal cover."""
    chosen: list[str] = []
    taken: set[str] = set()
    by_prefix: dict[str, list[str]] = {}
    for form in docs_of:
        for n in range(1, len(form)):
            by_prefix.setdefault(form[:n], []).append(form)
    for form in sorted(docs_of, key=lambda f: (len(f), f)):
        if any(form[:n] in taken for n in range(1, len(form))):
            continue
        taken.add(form)
        same = [f for f in by_prefix.get(form, []) if docs_of[f] == docs_of[form] and not form.endswith("$")]
        chosen.append(max([form, *same], key=lambda f: (len(f), f)))
    chosen.sort(key=lambda f: (-docs_of[f], f))
    return [(f, Term(f[:-1], True) if f.endswith("$") else Term(f, False), docs_of[f]) for f in chosen]


class Matcher(dict):
    """Word -> 0, or the number of its term: positive as in the lexicon, negative misspelt. Words of `ordinary` are
    never misspellings."""

    def __init__(self, terms: list[tuple[Term, float]], ordinary: frozenset[str] = frozenset()):
        super().__init__()
        self.lexicon, self.ordinary = FuzzyLexicon([t for t, _ in terms], anywhere=True), ordinary
        self.strength = [0.0, *[w for _, w in terms]]

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        number, edits = self.lexicon.look(word)
        found = number if not edits else 0 if word in self.ordinary else -number
        self[word] = found
        return found

    def hits(self, text: str) -> list[tuple[int, float, str]]:
        """(term, quotation, word) of each hit. quotation, 0 to 1, scores the window around it: how near an open
        quotation mark stands before and a closing one after it, and a word of reporting with either of them."""
        low = text.lower()
        words = _TOKEN.findall(low)
        found = list(map(self.__getitem__, words))
        if not any(found):
            return []
        spans = [m.span() for m in _TOKEN.finditer(low)]
        starts = [s for s, _ in spans]
        out = []
        for i, term in enumerate(found):
            if term:
                first, last = max(0, i - WINDOW), min(len(spans) - 1, i + WINDOW)
                begin, end = max(0, starts[first] - 1), spans[last][1] + 1 if last < len(spans) - 1 else len(low)
                opened = max((m.start() for m in _OPEN.finditer(low, begin, starts[i])), default=-1)
                shut = max((m.start() for m in _CLOSE.finditer(low, begin, starts[i])), default=-1)
                closing = _CLOSE.search(low, spans[i][1], end)
                before = 1 - (i - bisect_left(starts, opened)) / (WINDOW + 1) if opened > shut else 0.0
                after = 1 - (bisect_left(starts, closing.start()) - i - 1) / (WINDOW + 1) if closing else 0.0
                told = max((1 - (abs(j - i) - 1) / (WINDOW + 1) for j in range(first, last + 1) if words[j] in REPORTS), default=0.0)
                out.append((term, 1 - (1 - before * after) * (1 - told * max(before, after)), words[i]))
        return out

    def features(self, hits: list[tuple[int, float, str]]) -> list[float]:
        """FEATURES of a document; a hit counts by what its context leaves of it."""
        best: dict[int, float] = {}
        for t, c, _ in hits:
            if t > 0:
                best[t] = max(best.get(t, 0.0), 1 - c)
        fuzzy = [1 - c for t, c, _ in hits if t < 0]
        strength = sum(self.strength[t] * live for t, live in best.items())
        plain = sum(1 - c for t, c, _ in hits if t > 0)
        return [max(best.values(), default=0.0), strength**0.5, math.log1p(plain), max(fuzzy, default=0.0), math.log1p(sum(fuzzy)), math.log1p(sum(c for _, c, _ in hits))]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept comes first and bears no penalty."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty), a.T @ (weight * (y - p)) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, terms: list[tuple[Term, float]], ordinary: frozenset[str], weights: list[float]):
        self.terms, self.ordinary, self.weights = terms, ordinary, weights


def _misspelt(word: str) -> str:
    at = len(word) // 2
    return word[:at] + ("x" if word[at] != "x" else "z") + word[at + 1 :]


def _settled(rows: DataFrame, terms: list[tuple[Term, float]]) -> tuple[list[tuple[Term, float]], frozenset[str]]:
    """(terms, ordinary words): what looks misspelt in clean rows is an ordinary word, and a term with CROWDED of them
    around it is taken to the letter. Words of at most TRAIN_ROWS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, seen = Matcher(terms), set()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen |= {(-n, w) for n, _, w in matcher.hits(t) if n < 0}
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in sorted(seen)], pa.int32()), pa.array([w for _, w in sorted(seen)], pa.string())], names=["n", "w"])

    found = rows.where("toxic = 0").select("text").mapInArrow(run, "n int, w string").distinct().collect()
    around = Counter(r.n for r in found)
    return [(t._replace(exact=around[i] >= CROWDED), x) for i, (t, x) in enumerate(terms, 1)], frozenset(r.w for r in found)


def _measured(rows: DataFrame, terms: list[tuple[Term, float]], ordinary: frozenset[str]) -> list:
    """(toxic, weight, features) of each training row, and of toxic rows with their terms misspelt: at most twice
    TRAIN_ROWS small rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, ordinary)
        for batch in batches:
            toxic, weight, features = [], [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = matcher.hits(text)
                toxic.append(y), weight.append(1.0), features.append(matcher.features(hits))
                if y == 1 and any(n > 0 for n, _, _ in hits):
                    low = text.lower()
                    for w in sorted({w for n, _, w in hits if n > 0}):
                        low = low.replace(w, _misspelt(w))
                    hits = matcher.hits(low)
                    if any(n < 0 for n, _, _ in hits):
                        toxic.append(y), weight.append(MISSPELT_WEIGHT), features.append(matcher.features(hits))
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(weight, pa.float64()), pa.array(features, pa.list_(pa.float64()))], names=["toxic", "weight", "x"])

    return [(r.toxic, r.weight, r.x) for r in rows.select("toxic", "text").mapInArrow(run, "toxic int, weight double, x array<double>").collect()]


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Learn from a bounded sample. The weights come from features of rows whose lexicon was learnt on the other
    half, so that they know how far a lexicon carries over; the lexicon in use is that of all rows. Words that look
    misspelt in clean rows are ordinary. Without toxic or clean rows every score is the share of toxic rows."""
    work = Workspace(docs.sparkSession, "toxicity")
    half = (F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))).cast("int").alias("half")
    rows = work.keep(training_rows(docs, labels, most).select("*", half), "train")
    terms = learn_lexicon(work, rows)
    measured = []
    for h in (0, 1):
        mine = rows.where(f"half = {h}")
        measured += _measured(rows.where(f"half <> {h}"), *_settled(mine, learn_lexicon(work, mine)))
    terms, ordinary = _settled(rows, terms)
    work.drop(rows)
    x = np.array([f for _, _, f in measured]).reshape(-1, len(FEATURES))
    y = np.array([float(t == 1) for t, _, _ in measured])
    weight = np.array([w for _, w, _ in measured])
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return Model(terms, ordinary, [bias, *[0.0] * len(FEATURES)])
    return Model(terms, ordinary, fit(x, y, weight).tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1). Only the text counts; null texts are empty, texts of any length are read whole. Repeated
    rows are scored each, an empty table gives no row, and a column score of docs gives way."""
    kept = [c for c in docs.columns if c != "score"]
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        matcher, w = Matcher(m.terms, m.ordinary), np.array(m.weights)
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            z = [w[0] + float(np.dot(w[1:], matcher.features(matcher.hits(t)))) if t else w[0] for t in texts]
            scores = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(scores, pa.float64())], names=[*kept, "score"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept) + "score double"
    return docs.select(*[f"`{c}`" for c in kept], F.col("text").alias("text_")).mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels)
    told = docs.select("doc_id", "text")
    scored = score(told, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
