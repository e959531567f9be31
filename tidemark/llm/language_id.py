"""Language identification by a convolutional network over bytes, trained in numpy.

A text, in lower case and UTF-8, is cut into windows of a fixed length. Each
window's bytes are embedded; filters of several widths run over them; each
filter's greatest response in the window is kept; a softmax over these gives the
window's probabilities. A text's probabilities are the mean over all its windows,
weighted by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, tidy

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")

#: Bounds of the training sample: labelled rows for each language (about), of all languages together (about; one of each at least), windows of each row.
ROWS_PER_LANGUAGE = 600
SAMPLE_ROWS = 60_000
WINDOWS_PER_ROW = 4


def windows(text: str, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last one filled up with zero bytes, and how many bytes of each are text."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-len(raw) // length))
    out = np.zeros(n * length, np.uint8)
    out[: len(raw)] = raw
    size = np.full(n, length)
    size[-1] = len(raw) - (n - 1) * length
    return out.reshape(n, length), size


@dataclass
class Network:
    """Embedding (256, e), filters (widest * e, f) of which narrow ones are zero below, output (f, languages)."""

    names: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, length) bytes to (windows, length, widest * e): at each place the embeddings from there on."""
        widest, e = max(WIDTHS), self.embed.shape[1]
        v = np.zeros((len(x), x.shape[1] + widest - 1, e), np.float32)
        v[:, : x.shape[1]] = self.embed[x]
        s = v.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(v, (len(x), x.shape[1], widest * e), s))

    def pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All responses, each filter's greatest in each window, and the columns."""
        c = self.columns(x)
        a = (c.reshape(-1, c.shape[2]) @ self.filters).reshape(c.shape[0], c.shape[1], -1)
        return a, a.max(1) + self.bias, c

    def probabilities(self, x: np.ndarray, step: int = 64) -> np.ndarray:
        out = np.empty((len(x), len(self.names)), np.float64)
        for i in range(0, len(x), step):
            out[i : i + step] = softmax(self.pool(x[i : i + step])[1] @ self.out + self.out_bias)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its probability; ``und`` and 0 for null and for texts without a letter."""
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t is not None and self.names and _LETTER.search(t)]
        k = 0
        while k < len(known):
            cut, own, total = [], [], 0
            while k < len(known) and total < 4096:  # windows of some texts at a time
                w = windows(texts[known[k]])
                cut.append(w)
                own.append(known[k])
                total += len(w[0])
                k += 1
            p = self.probabilities(np.concatenate([w for w, _ in cut])) * np.concatenate([s for _, s in cut])[:, None]
            starts = np.cumsum([0, *(len(w) for w, _ in cut[:-1])])
            p = np.add.reduceat(p, starts)
            p /= p.sum(1, keepdims=True)
            for i, row in zip(own, p, strict=True):
                best = int(row.argmax())
                names[i], scores[i] = self.names[best], min(1.0, float(row[best]))
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, names: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 1) -> Network:
    """Fit a network to windows ``x`` of the languages ``y`` (indexes into ``names``), each language weighing the same."""
    rng = np.random.default_rng(seed)
    e, f, widest = EMBED, FILTERS * len(WIDTHS), max(WIDTHS)
    mask = np.zeros((widest * e, f), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * e, i * FILTERS : (i + 1) * FILTERS] = 1
    p = [
        rng.normal(0, 0.5, (256, e)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(2 * e), (widest * e, f)).astype(np.float32) * mask,
        np.zeros(f, np.float32),
        rng.normal(0, 0.1, (f, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    ]
    p[0][0] = 0  # what windows are filled up with
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    share = len(y) / (len(names) * np.maximum(np.bincount(y, minlength=len(names)), 1))
    cols = np.arange(f)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            net = Network(names, *p)
            a, h, c = net.pool(x[own])
            at = a.argmax(1)
            d = softmax(h @ p[3] + p[4])
            d[np.arange(len(own)), y[own]] -= 1
            d *= (share[y[own]] / len(own))[:, None]
            dh = (d @ p[3].T).astype(np.float32)
            rows = np.arange(len(own))[:, None]
            picked = c[rows, at]  # (batch, filters, widest * e)
            g = [np.zeros_like(p[0]), np.einsum("bfk,bf->kf", picked, dh) * mask, dh.sum(0), h.T @ d, d.sum(0)]
            back = (dh[:, :, None] * p[1].T[cols]).reshape(len(own), f, widest, e)
            padded = np.pad(x[own], ((0, 0), (0, widest - 1)))
            for j in range(widest):
                np.add.at(g[0], padded[rows, at + j].ravel(), back[:, :, j].reshape(-1, e))
            g[0][0] = 0
            step += 1
            for k in range(len(p)):
                gk = g[k].astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network(names, *p)


def sample_windows(labelled: DataFrame, text: str, lang: str, key: Column, rows: int = ROWS_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """Windows of about ``rows`` rows of each language (fewer where there are very many languages), chosen by a hash of ``key``, in a fixed order."""
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = labelled.groupBy(lang).count().collect()  # a row for each language, as many as the network has outputs
    if not counts:
        return []
    rows = max(1, min(rows, SAMPLE_ROWS // len(counts)))
    share = F.element_at(F.create_map(*[F.lit(x) for name, n in counts for x in (name, min(1.0, rows / n))]), F.col(lang))
    draw = F.pmod(F.xxhash64(key, F.lit("language id")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(draw < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            langs, cut = [], []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not _LETTER.search(t):
                    continue
                w, _ = windows(t)
                rng = np.random.default_rng(len(t))
                for k in rng.choice(len(w), min(len(w), WINDOWS_PER_ROW), replace=False):
                    langs.append(name)
                    cut.append(w[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cut, pa.binary())], ["lang", "cut"])

    return sorted((r[0], bytes(r[1])) for r in chosen.mapInArrow(run, "lang string, cut binary").collect())


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: Column | None = None) -> Network:
    """A network from labelled rows (bounded sample, see ``sample_windows``); one that knows no language if there are none."""
    found = sample_windows(labelled, text, lang, F.col("doc_id") if key is None else key)
    names = sorted({name for name, _ in found})
    if not names:
        return Network([], *[np.zeros((1, 1), np.float32)] * 5)
    x = np.frombuffer(b"".join(w for _, w in found), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([names.index(name) for name, _ in found]), names)


def identify(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (underscores added to these names if ``docs`` has them).

    Every row gives a row, and an empty table an empty one. Null text and text
    without a letter are ``und`` with score 0; only the text is looked at, all of
    it however long. Of languages that are equally likely the first by name is taken.
    """
    names = [fresh_name(docs, "lang_pred"), fresh_name(docs, "score")]
    at = docs.columns.index(text_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{names[0]}` string, `{names[1]}` double"])

    def run(batches):
        for batch in batches:
            langs, scores = network.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])

    return docs.mapInArrow(tidy(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are kept from training: crc32 of the id as text leaves 1 when divided by 3. A missing id isn't one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), network)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
