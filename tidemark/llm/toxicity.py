"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

The model has one weight vector and one threshold for each step between grades:
P(grade <= g) = logistic(threshold_g - w . x).  Expected severity is the sum over steps of P(grade > g).

Features are the words whose documents are toxic clearly more often than others, once as presence and once
as a rate.  Labels only say toxic or not, so grades are made from them: 0 not toxic, 1 toxic without
marked words, 2 and 3 toxic with fewer and with more of them.

The classifier, features included, is fitted on ``SAMPLE`` labelled rows, the first by the hash of their
ids.  That bounds what is broadcast to find their documents (an id and a label each), what the driver sees,
and the texts that are shuffled, whatever the size of the tables.  Scoring is one pass over all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Labelled rows the classifier is fitted on.
SAMPLE = 20_000
#: Size of the model: the clearest marked words that it takes in.
VOCABULARY = 4_096
#: Standard errors by which a word's toxic share must exceed the overall share, and its least documents.
CLEAR, LEAST = 6.0, 5
#: Marked words in a hundred that part grade 2 from grade 3.
SEVERE = 2.0
#: Expected severity from which a document is rejected where no labels tell; else the cut is chosen on them.
REJECT = 1.0
#: Share of clean labelled documents that the cut may reject, and the folds that it is chosen over.
LOST, FOLDS = 0.001, 5
GRADES = 4

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Ordinal:
    """Cumulative-link model: ``weights`` by feature, ``cuts`` in ascending order."""

    weights: np.ndarray
    cuts: np.ndarray
    features: list[str] = field(default_factory=list)
    reject: float = REJECT

    def severity(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(self.at_least(np.array([self.weights[at] @ value if len(at) else 0.0])).sum())

    def at_least(self, s: np.ndarray) -> np.ndarray:
        """P(grade > g) for each step g, one row for each score."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - np.asarray(s)[:, None], -500, 500)))


def fit_ordinal(x, y: np.ndarray, n_features: int, grades: int = GRADES, l2: float = 1e-3, rounds: int = 300) -> Ordinal:
    """Maximum likelihood with an L2 penalty on the weights, by L-BFGS.

    ``x`` is a list of (indices, values); ``y`` holds grades 0 .. grades - 1.  The thresholds are kept in
    order by fitting the first and the logarithms of the gaps.  A grade without rows gets the smallest
    gap, so its probability is about zero.
    """
    rows = np.concatenate([np.full(len(i), r) for r, (i, _) in enumerate(x)] or [np.zeros(0)]).astype(int)
    cols = np.concatenate([i for i, _ in x] or [np.zeros(0)]).astype(int)
    vals = np.concatenate([v for _, v in x] or [np.zeros(0)]).astype(float)
    n, steps = len(y), grades - 1
    share = np.array([(np.sum(y <= g) + 0.5) / (n + 1) for g in range(steps)])
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    theta = np.concatenate([np.zeros(n_features), start[:1], gaps])

    def unpack(t):
        return t[:n_features], np.concatenate([t[n_features:n_features + 1], t[n_features] + np.cumsum(np.exp(np.clip(t[n_features + 1:], -12, 12)))])

    def loss(t):
        w, cuts = unpack(t)
        s = np.bincount(rows, vals * w[cols], minlength=n) if n else np.zeros(0)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        up, low = edges[y + 1] - s, edges[y] - s
        cdf = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        fu, fl = cdf(up), cdf(low)
        # stable P(grade): 1 - exp(low - up) stays accurate in both tails
        p = np.where(low > 0, cdf(-low) - cdf(-up), fu - fl)
        p = np.maximum(p, 1e-300)
        du, dl = fu * (1 - fu) / p, fl * (1 - fl) / p
        grad_w = np.bincount(cols, vals * (du - dl)[rows], minlength=n_features) / max(n, 1) + l2 * w
        grad_cut = np.array([-(du[y == g].sum() - dl[y == g + 1].sum()) / max(n, 1) for g in range(steps)])
        tail = np.cumsum(grad_cut[::-1])[::-1]
        grad = np.concatenate([grad_w, tail[:1], tail[1:] * np.exp(np.clip(t[n_features + 1:], -12, 12))])
        return -np.log(p).sum() / max(n, 1) + l2 / 2 * (w @ w), grad

    theta = _lbfgs(loss, theta, rounds)
    w, cuts = unpack(theta)
    return Ordinal(w, cuts)


def _lbfgs(loss, t: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    f, g = loss(t)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            alphas.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(alphas)):
            d = d + s * (a - (y @ d) / (s @ y))
        slope = g @ d
        if slope >= 0:
            d, slope, past = -g, -(g @ g), []
        step = 1.0 if past else min(1.0, 1 / max(np.abs(g).max(), 1e-12))
        while True:
            nf, ng = loss(t + step * d)
            if nf <= f + 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        s, y = step * d, ng - g
        done = f - nf < 1e-10 * max(1.0, abs(f))
        t, f, g = t + s, nf, ng
        if s @ y > 1e-12:
            past = (past + [(s, y)])[-memory:]
        if done:
            break
    return t


def choose_cut(x, y: np.ndarray, fold: np.ndarray, n_features: int) -> float:
    """The least severity that rejects at most ``LOST`` of the clean rows, each judged by a fit without its fold.

    The cut lies halfway between the clean rows it spares and the next toxic one.  Without toxic or without clean
    rows, or where no toxic row lies above the clean ones, it is ``REJECT``.
    """
    found = np.zeros(len(y))
    for f in np.unique(fold):
        seen = np.flatnonzero(fold != f)
        model = fit_ordinal([x[i] for i in seen], y[seen], n_features)
        for i in np.flatnonzero(fold == f):
            found[i] = model.severity(*x[i])
    clean, toxic = np.sort(found[y == 0]), np.sort(found[y > 0])
    if not len(clean) or not len(toxic):
        return REJECT
    spared = clean[len(clean) - 1 - int(LOST * len(clean))]
    above = toxic[np.searchsorted(toxic, spared, side="right"):]
    return float((spared + above[0]) / 2) if len(above) else REJECT


def vectorise(words: list[str], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sparse features of a document (presence, then rate in a hundred), and its number of marked words."""
    found = Counter(map(index.get, words))
    found.pop(None, None)
    if not found:
        return np.zeros(0, int), np.zeros(0), 0
    at = np.array(sorted(found), int)
    count = np.array([found[i] for i in at], float)
    return (np.concatenate([at, at + len(index)]), np.concatenate([np.ones(len(at)), np.minimum(100 * count / len(words), 10.0)]), int(count.sum()))


def marked_words(labelled: DataFrame) -> list[str]:
    """The words whose documents are toxic clearly more often than documents overall, clearest first.

    ``labelled`` has text and toxic.  Equal texts count once.
    """
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        bad: Counter = Counter()

        def out():
            keys = list(n)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()),
                                               pa.array([bad[k] for k in keys], pa.int64())], names=["word", "n", "bad"])
        for batch in it:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                seen = set(tokens(text.as_py()))
                seen.add("")  # counts documents
                n.update(seen)
                if toxic.as_py() == 1:
                    bad.update(seen)
            if len(n) > 300_000:
                yield out()
                n.clear()
                bad.clear()
        if n:
            yield out()

    once = labelled.groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    stats = once.select("text", "toxic").mapInArrow(count, "word string, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    stats = cut(stats.filter(F.col("n") >= LEAST))
    total = stats.filter("word = ''").first()
    if total is None or not total.bad or total.bad == total.n:
        return []
    p = total.bad / total.n
    z = (F.col("bad") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    top = stats.filter("word <> ''").withColumn("z", z).filter(F.col("z") >= CLEAR).orderBy(F.desc("z"), "word").limit(VOCABULARY)
    return [r.word for r in top.select("word").collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Ordinal:
    """The severity model from documents (doc_id, text) and labels (doc_id, toxic 0 or 1).

    Labels without a document, with null toxic or null text are not used; a doc_id that is labelled more
    than once counts as toxic if any label says so, and one that repeats in the documents gives its least text.
    Grades above 1 follow the rate of marked words, as labels are 0 or 1.  Words are chosen on all labelled rows; the
    cut for rejection on fits that leave the judged rows out.  Empty tables are as no labels.  Without usable or without toxic labels the model
    finds nothing toxic.
    """
    truth = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = cut(truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    # one row for each labelled id: the sample bounds what is collected, however often an id repeats
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")
    labelled = cut(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).withColumn(
        "fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")))
    features = marked_words(labelled.select("text", "toxic"))
    index = {w: i for i, w in enumerate(features)}
    if not index:
        return Ordinal(np.zeros(0), np.array([50.0, 51.0, 52.0]), [])

    def sparse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [vectorise(w, index) + (len(w),) for w in (tokens(t.as_py()) for t in b.column(0))]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                pa.array([100.0 * r[2] / max(1, r[3]) for r in rows], pa.float64()), b.column(1), b.column(2)], names=["at", "value", "rate", "toxic", "fold"])

    got = labelled.select("text", "toxic", "fold").mapInArrow(sparse, "at array<int>, value array<double>, rate double, toxic int, fold int").toPandas()
    toxic, rate = got["toxic"].to_numpy() == 1, got["rate"].to_numpy()
    y = np.where(toxic, 1 + (rate > 0) + (rate >= SEVERE), 0)
    x = [(np.asarray(a, int), np.asarray(v, float)) for a, v in zip(got["at"], got["value"])]
    model = fit_ordinal(x, y, 2 * len(index))
    model.features = features
    model.reject = choose_cut(x, y, got["fold"].to_numpy(), 2 * len(index))
    return model


def grade(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``docs`` (any columns, with text) plus severity (expected grade), grade (the likeliest), p_toxic
    (P(grade >= 2)), rejected (severity at or above the model's cut).

    Null and empty texts have no features and get the severity of a document without marked words.
    Rows are independent.  Result columns replace input columns of the same name.
    """
    out = ["severity", "grade", "p_toxic", "rejected"]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in out])
    index = {w: i for i, w in enumerate(model.features)}
    fields = ", ".join(f"`{c}` {kind}" for c, kind in kept.dtypes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = []
            for t in b.column(b.schema.get_field_index("text")):
                at, value, _ = vectorise(tokens(t.as_py()), index) if index else ([], [], 0)
                s.append(float(model.weights[at] @ value) if len(at) else 0.0)
            over = model.at_least(np.array(s))
            severity = over.sum(axis=1)
            each = -np.diff(np.concatenate([np.ones((len(s), 1)), over, np.zeros((len(s), 1))], axis=1), axis=1)
            new = [pa.array(severity), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(over[:, 1]), pa.array(severity >= model.reject)]
            yield pa.RecordBatch.from_arrays(list(b.columns) + new, names=b.schema.names + out)

    return kept.mapInArrow(run, f"{fields}, severity double, grade int, p_toxic double, rejected boolean")


def graded(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``labelled_docs`` and ``labels``, then grade ``docs``."""
    return grade(docs, fit(labelled_docs, labels))
