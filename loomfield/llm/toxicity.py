"""Toxicity scores by a convolutional text classifier in numpy.

Words and their first letters are hashed to buckets with trained embeddings, which are
added; filters of several widths slide
over the whole text and each keeps its largest value; a logistic layer makes the
score. Training (Adam, sparse through the maxima) takes a bounded, hash-chosen sample
of labelled rows; the weights are of fixed size and go to every task,
where each filter is a table of word contributions, so scoring is lookups and sums.

Thresholds are calibrated by language over all labelled rows: the language is guessed
from the text's own common words, labels are counted by language and score, and scores
are shifted so that each language's best threshold falls on one value. A row of the
sample counts by the score of a model that was fitted without its fold, all others by
the model itself. Labels, ids, sources and language columns are never inputs of a score.

Null and empty texts have no words and get the score of an empty text. Texts of any
length are scored whole; equal texts have equal scores. Repeated rows each give a row,
repeated or contradicting labels each count; extra columns, of whatever name, are
ignored. Without labelled rows of both classes every score is 0; an empty table gives an
empty result. Of filter values and thresholds that tie the first counts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm.arrays import NOT_WORD, groups, words_of
from loomfield.llm.common import stored

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 8
#: Bytes of a word that have an embedding of their own.
FIRST = 4
#: Labelled rows to train on at most.
TRAIN_ROWS = 4000
#: Bytes of their texts at most: rows beyond these, in the order of the hash, are not trained on.
TRAIN_BYTES = 64 << 20
#: Parts of these; each is scored by a model of the other parts for the thresholds.
FOLDS = 4
#: Few rows are passed over until so many steps are made, at most so often.
LEAST_STEPS, MOST_EPOCHS = 300, 60
THRESHOLD = 0.7
#: Thresholds are chosen among steps of 1 / STEPS in the logit, from -LIMIT to LIMIT.
STEPS, LIMIT = 64, 30
#: All languages' counts stand beside a language's own with the weight of so many toxic rows.
PRIOR = 5
#: Common words by which a text's language is guessed (fixed values).
COMMON = {
    "de": "der die das und ein eine mit nicht von zu ist den auf für sich",
    "en": "the of and to in that is was for it with as on by",
    "es": "el los que en un una por con para del se las es no",
    "fr": "le les des et une dans qui sur pas du est pour avec au",
}


@dataclass
class Model:
    tables: list[np.ndarray]  # by width: buckets x (width * filters)
    bias: np.ndarray
    out: np.ndarray
    constant: float
    common: list[np.ndarray]
    shift: np.ndarray  # by guessed language, the last for none

    def logits(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        ids = (words % np.uint64(BUCKETS)).astype(np.int64)
        pooled = np.concatenate([_largest(_conv_tables(ids, t, w), at, w) for w, t in zip(WIDTHS, self.tables, strict=True)], axis=1)
        # Summed row by row: a product of matrices may differ in the last place with the rows beside it.
        return (np.maximum(pooled + self.bias, 0) * self.out).sum(axis=1) + self.constant

    def language(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        hits = np.stack([np.diff(np.concatenate([[0], np.cumsum(np.isin(words[0], c))])[at]) for c in self.common], axis=1)
        return np.where(hits.max(axis=1) > 0, hits.argmax(axis=1), len(self.common))


def _conv_tables(ids: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """The filters' values at each place where width words follow."""
    n = ids.shape[1] - width + 1
    z = np.zeros((max(n, 0), FILTERS), np.float32)
    for j in range(width if n > 0 else 0):
        part = np.ascontiguousarray(table[:, j * FILTERS : (j + 1) * FILTERS])
        for row in ids:
            z += part[row[j : n + j]]
    return z


def _largest(z: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The largest value of each filter in each text, 0 where the text is too short."""
    best = np.zeros((len(at) - 1, FILTERS), np.float32)
    n = np.diff(at)
    ok = np.flatnonzero(n >= width)
    if not len(ok):
        return best
    valid = np.ones(len(z), bool)
    for j in range(1, width):  # places whose words reach into the next text
        e = at[1:][n > 0] - j
        valid[e[(e >= 0) & (e < len(z))]] = False
    z[~valid] = -np.inf
    cuts = at[:-1][ok]
    best[ok] = np.maximum.reduceat(z, cuts, axis=0)
    return best


def _places(z: np.ndarray, best: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, filter, place) of each maximum."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)[: len(z)]
    row, f = np.nonzero(z == best[doc])
    d = doc[row]
    keep = n[d] >= width
    row, f, d = row[keep], f[keep], d[keep]
    _, first = np.unique(d * FILTERS + f, return_index=True)
    return d[first], f[first], row[first]


def _take(words: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)[rows]
    new = np.concatenate([[0], np.cumsum(n)])
    return words[:, np.repeat(at[:-1][rows] - new[:-1], n) + np.arange(new[-1])], new


def _common() -> list[np.ndarray]:
    return [words_of(pa.array([w]), NOT_WORD)[0] for w in COMMON.values()]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [words_of(texts.slice(a, b - a), NOT_WORD, FIRST) for a, b in groups(texts)]
    return np.concatenate([w for w, _ in parts], axis=1), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(cut) for _, cut in parts]))])


def _weights(words: np.ndarray, at: np.ndarray, y: np.ndarray, rows: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Model:
    """A model of the texts at rows, without thresholds: epochs passes, or as many as make LEAST_STEPS steps of few rows."""
    epochs = max(epochs, min(-(-LEAST_STEPS * batch // max(len(rows), 1)), MOST_EPOCHS))
    rng = np.random.default_rng(seed)
    rows = rows.copy()
    ids = (words % np.uint64(BUCKETS)).astype(np.int64)
    emb = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) / np.float32(w**0.5) for w in WIDTHS]
    bias, out, constant = np.full(FILTERS * len(WIDTHS), 0.1, np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), np.float32(0)
    state = {"t": 0}
    share = max(y[rows].mean(), 1e-3)
    weight = np.where(y == 1, min(4.0, 0.5 / share), 1.0).astype(np.float32)

    def adam(name, value, grad, where=None):
        m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        part = slice(None) if where is None else where
        m[part] = 0.9 * m[part] + 0.1 * grad
        v[part] = 0.99 * v[part] + 0.01 * grad * grad
        value[part] -= rate * (m[part] / (1 - 0.9 ** state["t"])) / (np.sqrt(v[part] / (1 - 0.99 ** state["t"])) + 1e-6)

    for _ in range(epochs):
        rng.shuffle(rows)
        for k in range(0, len(rows), batch):
            some = rows[k : k + batch]
            b, cut = _take(ids, at, some)
            if not b.size:
                continue
            state["t"] += 1
            used, local = np.unique(b, return_inverse=True)
            local = local.reshape(b.shape)
            e = emb[used]
            pooled, found = [], []
            for w, f in zip(WIDTHS, filters, strict=True):
                table = np.concatenate([e @ f[j] for j in range(w)], axis=1)
                z = _conv_tables(local, table, w)
                best = _largest(z, cut, w)
                pooled.append(best)
                found.append(_places(z, best, cut, w))
            h = np.concatenate(pooled, axis=1) + bias
            a = np.maximum(h, 0)
            p = 1 / (1 + np.exp(-np.clip(a @ out + constant, -30, 30)))
            g = (p - y[some]) * weight[some] / len(some)
            gh = np.outer(g, out) * (h > 0)
            ge = np.zeros_like(e)
            gf = []
            for i, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                d, c, place = found[i]
                gz = gh[d, i * FILTERS + c].astype(np.float32)
                grad = np.zeros_like(f)
                for j in range(w):
                    for row in local:
                        word = row[place + j]
                        np.add.at(grad[j].T, c, gz[:, None] * e[word])
                        np.add.at(ge, word, gz[:, None] * f[j].T[c])
                gf.append(grad)
            adam("out", out, a.T @ g + 1e-4 * out)
            adam("bias", bias, gh.sum(0))
            constant -= np.float32(rate * g.sum())
            for i, f in enumerate(filters):
                adam(f"f{i}", f, gf[i])
            adam("emb", emb, ge, used)

    return Model([np.concatenate([emb @ f[j] for j in range(w)], axis=1) for w, f in zip(WIDTHS, filters, strict=True)], bias, out, float(constant), _common(), np.zeros(len(COMMON) + 1))


def _apart(words: np.ndarray, at: np.ndarray, y: np.ndarray, fold: np.ndarray, k: int, batch: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of fold k with their logits by a model of all others, and languages."""
    rows = np.flatnonzero(fold == k)
    if not len(rows) or len(rows) == len(y):
        return rows[:0], np.zeros(0), np.zeros(0, np.int64)
    model = _weights(words, at, y, np.flatnonzero(fold != k))
    parts = [_take(words, at, rows[i : i + batch]) for i in range(0, len(rows), batch)]
    return rows, np.concatenate([model.logits(*p) for p in parts]), np.concatenate([model.language(*p) for p in parts])


def _counts(language, step, y, n) -> np.ndarray:
    """Rows by guessed language, step of the logit and label."""
    counts = np.zeros((len(COMMON) + 1, 2 * LIMIT * STEPS + 1, 2))
    np.add.at(counts, tuple(np.asarray(v, np.int64) for v in (language, step, y)), n)
    return counts


def _steps(x: np.ndarray) -> np.ndarray:
    return np.floor((np.clip(x, -LIMIT, LIMIT) + LIMIT) * STEPS).astype(np.int64)


def shifts(counts: np.ndarray) -> np.ndarray:
    """By language, what brings its best threshold to THRESHOLD."""
    goal, whole = np.log(THRESHOLD / (1 - THRESHOLD)), counts.sum(axis=0)
    return np.array([goal - _best_threshold(own + PRIOR / max(whole[:, 1].sum(), 1) * whole) for own in counts])


def _best_threshold(counts: np.ndarray) -> float:
    """The logit where F1 is best, in the middle of the gap there."""
    full = np.flatnonzero(counts.sum(axis=1))[::-1]
    if not counts[:, 1].any():
        return (full[0] + 1) / STEPS - LIMIT + 1 if len(full) else 0.0
    hits, taken = np.cumsum(counts[full, 1]), np.cumsum(counts[full].sum(axis=1))
    k = int(np.argmax(2 * hits / (taken + hits[-1])))
    below = (full[k + 1] + 1) / STEPS if k + 1 < len(full) else full[k] / STEPS - 1
    return float((full[k] / STEPS + below) / 2 - LIMIT)


def fit(texts: pa.Array, y: np.ndarray) -> Model:
    """A model of texts that are all the labelled rows, in this process."""
    words, at = _words(texts)
    fold = np.arange(len(y)) % FOLDS
    model = _weights(words, at, y, np.arange(len(y)))
    counts = 0
    for k in range(FOLDS):
        rows, x, language = _apart(words, at, y, fold, k)
        counts = counts + _counts(language, _steps(x), y[rows], 1)
    model.shift[:] = shifts(counts)
    return model


def _learn(spark: SparkSession, sample: pa.Table) -> tuple[Model, np.ndarray]:
    """A model of the sample (text, y, fold) and its rows' counts; a task for each fold, and one for the model."""
    shared = spark.sparkContext.broadcast((sample["text"].combine_chunks(), np.asarray(sample["y"]).astype(np.float32), np.asarray(sample["fold"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in [k for batch in batches for k in batch.column(0).to_pylist()]:
            texts, y, fold = shared.value
            words, at = _words(texts)
            if k == FOLDS:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([pickle.dumps(_weights(words, at, y, np.arange(len(y))))], pa.binary())], ["language", "step", "y", "model"])
                continue
            rows, x, language = _apart(words, at, y, fold, k)
            yield pa.RecordBatch.from_arrays([pa.array(language.astype(np.int32)), pa.array(_steps(x).astype(np.int32)), pa.array(y[rows].astype(np.int32)), pa.nulls(len(rows), pa.binary())], ["language", "step", "y", "model"])

    found = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(run, "language int, step int, y int, model binary").toArrow()
    shared.unpersist()
    held = found.filter(found["model"].is_null())
    return pickle.loads(found["model"].drop_null()[0].as_py()), _counts(held["language"], held["step"], held["y"], 1)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable=None, limit: int = TRAIN_ROWS) -> tuple[Model | None, np.ndarray, DataFrame]:
    """Fit on at most limit labelled rows, chosen by a hash of their id; usable says which ids may be learned from.

    Returns the model without thresholds, the counts of the rows it was fitted on, and
    all other labelled rows (id, y).
    """
    every = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col(label_col).isin(0, 1))
    if usable is not None:
        every = every.where(usable(F.col("id")))
    some = every.orderBy(F.xxhash64("id"), "id", "y").limit(limit)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(FOLDS)))
    # limit ids, of one row each but where ids repeat: so many rows are few enough for one task and the driver.
    first = Window.orderBy(F.xxhash64("id"), "id", "text", "y").rowsBetween(Window.unboundedPreceding, 0)
    found = found.orderBy(F.xxhash64("id"), "id", "text", "y").limit(2 * limit).withColumn("_b", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(first)).where(F.col("_b") <= TRAIN_BYTES).drop("_b").orderBy("id", "text").toArrow()
    y = np.asarray(found["y"])
    if not len(y) or y.min() == y.max():
        return None, _counts([], [], [], 0), every
    used = spark.createDataFrame(found.select(["id"])).distinct()
    return *_learn(spark, found), every.join(F.broadcast(used), "id", "left_anti")


def label_counts(scored: DataFrame, others: DataFrame) -> np.ndarray:
    """Counts of the labelled rows others by the logits of scored."""
    step = F.floor((F.greatest(F.least("logit", F.lit(float(LIMIT))), F.lit(-float(LIMIT))) + LIMIT) * STEPS)
    rows = scored.join(others, scored["id"] == others["id"]).groupBy("language", step.alias("step"), "y").agg(F.count("*").alias("n")).toArrow()  # bounded by the steps
    return _counts(rows["language"], rows["step"], rows["y"], np.asarray(rows["n"]))


def crc_third(doc_id):
    """crc32 of an id as text, modulo 3: rows of 1 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _logits(spark: SparkSession, docs: DataFrame, model: Model, id_col: str, text_col: str, key_col: str | None = None) -> DataFrame:
    """id (as it is), doc_id (or key_col), held_out, logit and guessed language of every whole text."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b in groups(batch.column(3)):
                part = batch.slice(a, b - a)
                words = words_of(part.column(3), NOT_WORD, FIRST)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(m.logits(*words).astype(np.float64)), pa.array(m.language(*words).astype(np.int32))], [*part.schema.names[:3], "logit", "language"])

    out = docs.select(F.col(id_col).alias("id"), F.col(key_col or id_col).cast("long").alias("doc_id"), F.coalesce(crc_third(F.col(id_col)) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return out.mapInArrow(run, f"id {out.schema['id'].dataType.simpleString()}, doc_id long, held_out boolean, logit double, language int")


def _judged(scored: DataFrame, shift: np.ndarray) -> DataFrame:
    x = F.col("logit") + F.get(F.array(*[F.lit(float(v)) for v in shift]), F.col("language"))
    score: Column = 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))
    return scored.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(spark: SparkSession, docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.7) of every whole text."""
    if model is None:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc_third(F.col(id_col)) == 1, F.lit(False)).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    return _judged(_logits(spark, docs, model, id_col, text_col), model.shift)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable=None, limit: int = TRAIN_ROWS, key_col: str | None = None) -> DataFrame:
    """toxicity() by a model of the labelled documents, with thresholds from all that usable lets pass.

    With key_col, a column of longs, rows have it as key instead of doc_id.
    """
    model, counts, others = train(spark, docs, labels, id_col, text_col, label_col, usable, limit)
    name, key_col = "doc_id" if key_col is None else key_col, key_col or id_col
    if model is None:
        return toxicity(spark, docs, None, key_col, text_col).withColumnRenamed("doc_id", name)
    scored = stored(spark, _logits(spark, docs, model, id_col, text_col, key_col), "logits")
    return _judged(scored, shifts(counts + label_counts(scored, others))).withColumnRenamed("doc_id", name)
