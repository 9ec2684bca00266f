"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

A text becomes its letters, lower-cased, with every run of other characters as one space; its subwords are all 1- to
4-grams of that, hashed into BUCKETS rows of an embedding; the mean of their embeddings goes through a linear softmax.
Embedding and softmax are trained together by stochastic gradient descent in numpy on pieces of labelled texts. Then
a temperature and rejection thresholds are fitted on documents that training held back: `score` is the calibrated
probability of the predicted language, and a document is rejected if its score is below what all but REJECT of the
held-back documents and of pieces of them reach, less SLACK of what that is below their median (in log odds; more where few rows are held back). A softmax is sure of texts that are like nothing it knows, so that a second
measure is calibrated too: the mean log frequency of a text's 3- and 4-grams in the predicted language. A document is
rejected if that is below the least of held-back pieces of its length, less SLACK of what these are below their median, and
below their median by MARGIN (so that texts partly in another language stay).
For prediction embedding and softmax are multiplied to one table, so that a subword costs
one row of it, and all of a text counts, however long.

Training draws on at most TRAIN_ROWS labelled rows, chosen by hash, and SAMPLE_CHARS characters of each; see `learn`. More
than MOST_LABELS different labels are an error.

Defined cases: null text or text without a letter: `und`, score 0, rejected. Without a labelled row all texts are `und`
with score 0. Ids and labels never reach the prediction. Repeated rows get a row each; equal scores: the smaller label; empty
tables give an empty table. Columns to keep may have any name; where one has that of a result, see `identify`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.llm.cluster import in_arrow, ship
from ripplet.llm.lexing import slices

TRAIN_ROWS, SAMPLE_CHARS, PIECE, BUCKETS, DIM, EPOCHS, RATE, REJECT, SLACK, MARGIN, MOST_LABELS = 4000, 8000, 400, 1 << 16, 16, 3, 0.5, 0.001, 0.15, 4.0, 500
#: Lengths of the held-back pieces by which rejection is calibrated beside whole texts.
SHORT = (20, 50, 100, 200, 400)
#: The same for frequencies; the n-grams that count there.
LENGTHS, FREQUENT = (6, 12, 20, 50, 100, 200, 400, SAMPLE_CHARS), (3, 4)
ORDERS = (1, 2, 3, 4)
_fold: np.ndarray | None = None
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def fold() -> np.ndarray:
    """Each code point's lower-case letter; 32 for what is no letter."""
    global _fold
    if _fold is None:
        t = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            if 0x20000 < c < 0xE0000 and c > 0x3FFFF:
                continue
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _fold = t
    return _fold


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, row starts, letters in each row) of " text " folded and with single spaces, one row after another."""
    raw = [f" {t} ".encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.array([len(r) // 4 for r in raw])
    cp = fold()[np.frombuffer(b"".join(raw), np.uint32)]
    row = np.repeat(np.arange(len(texts)), size)
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32) | (row[1:] != row[:-1])
    cp, row = cp[keep], row[keep]
    starts = np.searchsorted(row, np.arange(len(texts) + 1))
    has = np.add.reduceat(np.append(cp != 32, 0).astype(np.int64), starts[:-1]) if len(texts) else np.zeros(0, np.int64)
    return cp, starts, has


def subwords(cp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, buckets of the n-grams that begin at each position)."""
    h = np.zeros(len(cp), np.uint32)
    for n in ORDERS:
        if len(cp) < n:
            return
        h = h[: len(cp) - n + 1] * np.uint32(0x01000193) + (cp[n - 1 :] + np.uint32(n)) * _MULTIPLIERS[n - 1]
        x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        yield n, ((x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int64)


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    """Running positions: which of the n-grams at each position lie within one row."""
    ok = np.ones(max(0, int(starts[-1]) - n + 1), bool)
    for k in range(1, n):
        at = starts[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    seen: np.ndarray | None = None  # BUCKETS x languages: log frequencies of FREQUENT n-grams
    knots: tuple[list[float], list[float]] = ((0.0,), (-np.inf,))  # log of letters, least mean log frequency

    def familiar(self, texts: list[str], language: np.ndarray) -> np.ndarray:
        """The mean log frequency of each text's n-grams in the given language; 0 for texts that have none."""
        cp, starts, _ = letters(texts)
        total, count, row = np.zeros(len(texts)), np.zeros(len(texts)), np.repeat(np.arange(len(texts)), np.diff(starts))
        for n, b in subwords(cp):
            if n in FREQUENT:
                at = np.flatnonzero(_ends(starts, n))
                own = row[at]
                total += np.bincount(own, self.seen[b[at], language[own]], len(texts))
                count += np.bincount(own, minlength=len(texts))
        return total / np.maximum(count, 1)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, letters) of each text."""
        cp, starts, has = letters(texts)
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        size = np.diff(starts)
        for n, b in subwords(cp):
            ok = _ends(starts, n)
            v = self.table[b]
            if n > 1:
                v[~ok] = 0
            some = np.flatnonzero(starts[:-1] < len(v))
            if len(some):
                total[some] += np.add.reduceat(v, starts[some], axis=0)
            count += np.maximum(0, size - n + 1)
        return total / np.maximum(count, 1)[:, None] + self.bias, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        z, has = self.logits([t or "" for t in texts])
        known = (has > 0) & (len(self.languages) > 0)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        p = np.exp((z - z.max(axis=1, keepdims=True)) / self.temperature)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = np.where(known, p[np.arange(len(texts)), best], 0.0)
        rejected = ~known | (score < self.least)
        if self.seen is not None:
            rejected |= self.familiar([t or "" for t in texts], best) < np.interp(np.log(np.maximum(has, 1)), *self.knots)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, known)], score, rejected


def fit(texts: list[str], labels: list[str], seed: int = 11) -> Model:
    """Train on nine tenths of the texts, calibrate on the rest."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.Generator(np.random.PCG64(seed))
    part = rng.permutation(len(texts))
    part = np.split(part, [max(len(part) // 10, min(20, len(part) // 3))])
    held, train = part
    slack = SLACK * max(1.0, (TRAIN_ROWS / 10 / max(1, len(held))) ** 0.5)  # few held-back rows show less of what there is
    pieces, target = [], []
    for i in train:
        own = languages.index(labels[i])
        for k in range(0, max(1, len(texts[i])), PIECE):
            pieces.append((i, k))
            target.append(own)
    # every language weighs the same, and no more pieces are drawn than the rare ones can balance
    target = np.array(target)
    per = min(2000, max(500, int(np.bincount(target, minlength=len(languages)).min())))
    chosen = np.concatenate([rng.choice(w, per, replace=len(w) < per) for w in (np.flatnonzero(target == k) for k in range(len(languages))) if len(w)])
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    features = []
    for i in chosen:
        row, k = pieces[i]
        cp, _, _ = letters([texts[row][k : k + PIECE]])
        features.append(np.concatenate([b for _, b in subwords(cp)]).astype(np.uint16))
    del pieces
    batch = 16
    for epoch in range(EPOCHS):
        order = rng.permutation(len(chosen))
        rate = RATE * (1 - epoch / EPOCHS)
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            ids, size = np.concatenate([features[i] for i in own]), np.array([len(features[i]) for i in own])
            mean = np.add.reduceat(table[ids], np.cumsum(size) - size, axis=0) / size[:, None]
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), target[chosen[own]]] -= 1
            step = (p @ soft.T) * (rate * 20 / size)[:, None]
            soft -= rate * (mean.T @ p) / len(own) * 4
            bias -= rate * p.sum(axis=0) / len(own) * 0.1
            np.subtract.at(table, ids, np.repeat(step, size, axis=0).astype(np.float32))
    model = Model(languages, (table @ soft).astype(np.float32), bias.astype(np.float64))
    if len(held):
        z, has = model.logits([texts[i] for i in held])
        y = np.array([languages.index(labels[i]) for i in held])
        some = has > 0
        z, y = z[some], y[some]
        if len(z):

            def loss(t: float) -> float:
                s = (z - z.max(axis=1, keepdims=True)) / t
                return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

            # no temperature below 1: the held-back rows are too few to prove a sharper one
            model.temperature = float(min(np.geomspace(1, 10, 40), key=loss))
            p = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
            top = (p / p.sum(axis=1, keepdims=True)).max(axis=1)
            # short texts score lower: pieces of every length count beside the whole texts
            cut = [texts[i][at : at + size] for i in held for size in SHORT for at in [int(rng.integers(0, max(1, len(texts[i]) - size + 1)))]]
            z, has = model.logits(cut)
            z = z[has > 0]
            p = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
            top = np.concatenate([top, (p / p.sum(axis=1, keepdims=True)).max(axis=1)])
            # by log odds, as few held-back rows say little about so small a share
            odds = np.log(np.maximum(top, 1e-12)) - np.log(np.maximum(1 - top, 1e-12))
            low = np.quantile(odds, REJECT)
            model.least = float(1 / (1 + np.exp(-(low - slack * (np.median(odds) - low)))))
            counts = np.full((BUCKETS, len(languages)), 0.1)
            for i in train:
                cp, _, _ = letters([texts[i]])
                for n, b in subwords(cp):
                    if n in FREQUENT:
                        counts[:, languages.index(labels[i])] += np.bincount(b, minlength=BUCKETS)
            model.seen = np.log(counts / counts.sum(axis=0)).astype(np.float32)
            at, least = [], []
            for size in LENGTHS:
                cut = [texts[i][k : k + size] for i in held for k in rng.integers(0, max(1, len(texts[i]) - size + 1), 3)]
                z, has = model.logits(cut)
                some = has > 0
                f = model.familiar(cut, z.argmax(axis=1))[some]
                if len(f):
                    at.append(float(np.log(np.median(has[some]))))
                    least.append(float(min(f.min() - slack * (np.median(f) - f.min()), np.median(f) - MARGIN)))
            order = np.argsort(at, kind="stable")
            model.knots = ([at[k] for k in order], [least[k] for k in order])
    return model


def learn(labelled: DataFrame, text: str, label: str, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `rows` rows with a label, spread evenly over the labels and chosen by a hash of the text.

    Of a text of more than SAMPLE_CHARS characters a piece of that length counts, at a place chosen by its hash.
    """
    some = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("string").alias("y"))
    counts = {r.y: r.n for r in some.groupBy("y").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"column {label} has more than {MOST_LABELS} labels")
    if not counts:
        return fit([], [])
    # order by a uniform number over the label's share: the first rows are spread evenly; far ones never leave their task
    weight = F.create_map(*(F.lit(x) for y, n in counts.items() for x in (y, float(n))))
    place = (F.xxhash64("t", F.lit(5)).cast("double") / 2.0**64 + 0.5) * weight[F.col("y")]
    start = F.pmod(F.xxhash64("t", F.lit(6)), F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    near = some.withColumn("p", place).where(F.col("p") < 4.0 * rows / len(counts))
    got = near.select("p", F.substring("t", start, F.lit(SAMPLE_CHARS)).alias("t"), "y").orderBy("p", "t", "y").limit(rows).collect()
    texts, labels = [r.t for r in got], [r.y for r in got]
    del got
    return fit(texts, labels)


def identify(df: DataFrame, text: str, model: Model, keep: list[Column], names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns to keep of each row, with the predicted language, its score and whether it is rejected under the given names."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = df.select(*keep)
    # the text goes to the workers once
    rows = df.select(*keep, *([] if text in kept.columns else [F.col(f"`{text}`")]))
    at = f"c{rows.columns.index(text)}"
    cols = [f"c{i}" for i in range(len(kept.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in slices(batch, at, 500_000):
                lang, score, rejected = m.predict(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*cols, "lang", "score", "rejected"])

    schema = ", ".join([*(f"{c} {t}" for c, (_, t) in zip(cols, kept.dtypes)), "lang string, score double, rejected boolean"])
    return rows.toDF(*(f"c{i}" for i in range(len(rows.columns)))).transform(in_arrow, run, schema).toDF(*kept.columns, *names)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~F.coalesce(held_out(), F.lit(False))), "text", "lang")
    return identify(docs, "text", model, [F.col("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out")])
