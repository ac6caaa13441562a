"""Reading level of each document.

Each sentence gets a distribution over levels from a regularised linear model
of its words, their character n-grams and its shape; a document's level comes
from the distribution of its sentences through a calibrated second model
fitted on documents the first one did not see.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.common import spread, table

LEVELS = 4
GRAMS = 4096
SHAPES = 24
_UNIT = regex.compile(r"[^.?!;\n]+|\n+(?=\s*(?:[-*•]|\d+[.)]))|\n{2,}|[.?!;]|\n")
_WORD = regex.compile(r"[\p{L}\p{M}][\p{L}\p{M}'’-]*").findall

# fixed values: frequent function words by which a text's language is told
ENGLISH = frozenset("the a an of and or to in on is are was it this that these each every some one my our your we you they i at by for with from as if so but not be has have which when while there within through between after before into only now".split())
OTHER = frozenset("der die das und ist ein eine nicht den dem des mit auf für von zu sich wird nach jede el la los las un una de del que y en es se por con para está porque sin después le les des du et est une dans pour que qui sur pas il au ne o os do da em uma não com".split()) - ENGLISH


def is_english(found: list[str]) -> bool:
    """English by its function words, whatever the document says of itself."""
    if not found:
        return False
    en = sum(w in ENGLISH for w in found)
    other = sum(w in OTHER for w in found)
    return en > other and en >= 0.06 * len(found)


def sentences(text: str) -> list[list[str]]:
    """Words by sentence; a unit without a full stop is cut into runs of 30 words, pieces under 3 words join the one before."""
    out: list[list[str]] = []
    now: list[str] = []
    for unit in _UNIT.findall(text):
        if unit[0] in ".?!;" or unit[0] == "\n" and len(unit) > 1:
            if now:
                out.append(now)
                now = []
            continue
        now = now + _WORD(unit.lower()) if now else _WORD(unit.lower())
    if now:
        out.append(now)
    cut: list[list[str]] = []
    for s in out:
        if len(s) < 3 and cut:
            cut[-1] = cut[-1] + s
            continue
        n = max(1, round(len(s) / 30)) if len(s) > 45 else 1
        step = -(-len(s) // n)
        cut += [s[i : i + step] for i in range(0, len(s), step)]
    return cut


def _grams(word: str) -> list[int]:
    w = f"<{word}>"
    return [crc32(w[i : i + n].encode()) % GRAMS for n in (2, 3, 4) for i in range(len(w) - n + 1)] + [crc32(b"w" + w.encode()) % GRAMS + GRAMS]


def _shape(length: float, mean_letters: float) -> tuple[int, int]:
    return min(int(length / 4), 11), 12 + min(int(mean_letters * 1.5), 11)


class Reader:
    """Sentence model (word and character weights, shape weights) and document calibration."""

    def __init__(self, weights: np.ndarray, shapes: np.ndarray, calibration: np.ndarray):
        self.weights, self.shapes, self.calibration = weights, shapes, calibration
        self.place: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.matrix = np.zeros((0, LEVELS), dtype=np.float32)

    def _number(self, word: str) -> int:
        k = self.place.get(word)
        if k is None:
            g = _grams(word)
            row = self.weights[g[:-1]].mean(axis=0) + self.weights[g[-1]]
            k = self.place[word] = len(self.rows)
            self.rows.append(row)
        return k

    def features(self, texts: list[list[list[str]]]) -> np.ndarray:
        """Of each document, given as sentences of words, what its sentences' distributions say."""
        if len(self.place) > 300_000:
            self.place, self.rows, self.matrix = {}, [], np.zeros((0, LEVELS), dtype=np.float32)
        number = self._number
        flat = [s for doc in texts for s in doc]
        get = self.place.get
        ids = np.array([number(w) if (k := get(w)) is None else k for s in flat for w in s], dtype=np.int64)
        if len(self.rows) > len(self.matrix):
            self.matrix = np.vstack([self.matrix, np.array(self.rows[len(self.matrix) :], dtype=np.float32)])
        n = np.array([len(s) for s in flat])
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        letters = np.array([sum(map(len, s)) for s in flat]) / n
        z = np.add.reduceat(self.matrix[ids], start, axis=0) / n[:, None]
        z = z + self.shapes[np.minimum(n // 4, 11)] + self.shapes[12 + np.minimum((letters * 1.5).astype(int), 11)]
        p = _softmax(z)
        docs = np.array([len(d) for d in texts])
        return _features(p, n, docs)

    def levels(self, texts: list[list[list[str]]]) -> np.ndarray:
        return np.argmax(self.features(texts) @ self.calibration, axis=1) + 1 if texts else np.zeros(0, dtype=int)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(p: np.ndarray, n: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of each document: mean sentence distribution by words and by sentences, hard shares, log of the mean."""
    start = np.concatenate([[0], np.cumsum(docs)[:-1]])
    total = np.add.reduceat(n, start)[:, None]
    mean_w = np.add.reduceat(p * n[:, None], start, axis=0) / total
    hard = np.zeros_like(p)
    hard[np.arange(len(p)), p.argmax(axis=1)] = 1
    mean_h = np.add.reduceat(hard, start, axis=0) / docs[:, None]
    return np.hstack([mean_w * 4, mean_h * 4, np.log(mean_w + 0.01), np.ones((len(docs), 1))])


def _descend(x_forward, x_backward, size: int, target: np.ndarray, l2: float, steps: int, rate: float) -> np.ndarray:
    """Softmax regression by Adam on full batches."""
    w = np.zeros((size, LEVELS))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x_backward((_softmax(x_forward(w)) - target) / len(target)) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _fit_sentences(docs: list[list[list[str]]], target: np.ndarray, l2: float = 2e-5, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    flat = [(s, k) for k, d in enumerate(docs) for s in d]
    place: dict[str, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for s, _ in flat for w in s])
    n = np.array([len(s) for s, _ in flat])
    of = np.repeat(np.arange(len(flat)), n)
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    grams = [_grams(w) for w in place]
    g_ids = np.array([g for gs in grams for g in gs])
    g_weight = np.concatenate([np.append(np.full(len(gs) - 1, 1 / (len(gs) - 1)), 1.0) for gs in grams])[:, None]
    g_start = np.concatenate([[0], np.cumsum([len(gs) for gs in grams])[:-1]])
    g_of = np.repeat(np.arange(len(grams)), [len(gs) for gs in grams])
    shape = np.array([_shape(len(s), sum(map(len, s)) / len(s)) for s, _ in flat])
    y = target[[k for _, k in flat]]
    inv = (1 / n)[:, None]

    def forward(w):
        word = np.add.reduceat(w[g_ids] * g_weight, g_start, axis=0)
        sh = w[2 * GRAMS :]
        return np.add.reduceat(word[ids], start, axis=0) * inv + sh[shape[:, 0]] + sh[shape[:, 1]]

    def backward(r):
        each = (r * inv)[of]
        word = np.stack([np.bincount(ids, each[:, c], len(place)) for c in range(LEVELS)], axis=1)
        per = word[g_of] * g_weight
        out = np.stack([np.bincount(g_ids, per[:, c], 2 * GRAMS + SHAPES) for c in range(LEVELS)], axis=1)
        for k in (0, 1):
            out[2 * GRAMS :] += np.stack([np.bincount(shape[:, k], r[:, c], SHAPES) for c in range(LEVELS)], axis=1)
        return out

    w = _descend(forward, backward, 2 * GRAMS + SHAPES, y, l2, steps, 0.3)
    return w[: 2 * GRAMS], w[2 * GRAMS :]


def _fit_fold(docs: list[list[list[str]]], target: np.ndarray, fold: int | None, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sentence model on all documents but those of a fold (of all, without one), and what it says of the fold's documents."""
    part = np.arange(len(docs)) % folds
    seen, held = np.flatnonzero(part != fold), np.flatnonzero(part == fold)
    if fold is None:
        return *_fit_sentences(docs, target), None
    if not len(held) or not len(seen):
        return np.zeros((2 * GRAMS, LEVELS)), np.zeros((SHAPES, LEVELS)), None
    w, sh = _fit_sentences([docs[i] for i in seen], target[seen])
    return w, sh, Reader(w, sh, np.zeros((13, LEVELS))).features([docs[i] for i in held])


def fit(docs: list[list[list[str]]], target: np.ndarray, folds: int = 3, spark: SparkSession | None = None) -> Reader:
    """Sentence model on all documents; calibration on sentence distributions from models that did not see the document.

    target: rows of level shares (several readers may disagree). With a
    session the models are fitted as tasks side by side.
    """
    if not docs:
        return Reader(np.zeros((2 * GRAMS, LEVELS)), np.zeros((SHAPES, LEVELS)), np.vstack([np.eye(LEVELS), np.zeros((9, LEVELS))]))
    wanted = [None, *range(folds)]
    if spark is None:
        made = [_fit_fold(docs, target, k, folds) for k in wanted]
    else:
        shared = spark.sparkContext.broadcast((docs, target))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(_fit_fold(*shared.value, wanted[k], folds))], pa.binary())], names=["k", "model"])

        # one task per model; each comes back as some hundred kilobytes
        got = spark.range(len(wanted), numPartitions=len(wanted)).mapInArrow(run, "k long, model binary").collect()
        made = [pickle.loads(r.model) for r in sorted(got, key=lambda r: r.k)]
        shared.unpersist()
    part = np.arange(len(docs)) % folds
    some = [(x, target[part == k]) for k, (_, _, x) in zip(wanted, made, strict=True) if x is not None]
    if not some:
        return Reader(*made[0][:2], np.vstack([np.eye(LEVELS), np.zeros((9, LEVELS))]))
    xs, ys = (np.vstack(z) for z in zip(*some, strict=True))
    calibration = _descend(lambda w: xs @ w, lambda r: xs.T @ r, xs.shape[1], ys, 1e-4, 400, 0.05)
    return Reader(*made[0][:2], calibration)


def fit_reader(docs: DataFrame, labels: DataFrame, sample: int) -> Reader:
    """Fitted on at most `sample` labelled documents, those first in hash order; whole texts."""
    votes = (
        labels.filter(F.col("level").between(1, LEVELS) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(*[F.count_if(F.col("level") == k).alias(f"n{k}") for k in range(1, LEVELS + 1)])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # the bounded side is broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(votes), "doc_id").orderBy("doc_id").toLocalIterator()
    texts, target = [], []
    for r in rows:
        if r.text and is_english(_WORD(r.text.lower())) and (s := sentences(r.text)):
            texts.append(s)
            n = np.array([r.n1, r.n2, r.n3, r.n4], dtype=float)
            target.append(n / n.sum())
    return fit(texts, np.array(target).reshape(-1, LEVELS), spark=docs.sparkSession)


def reading_levels(docs: DataFrame, labels: DataFrame, least_words: int = 40, sample: int = 1500) -> DataFrame:
    """(doc_id, level) of each English document of at least `least_words` words separated by white space.

    Null, empty and short texts, texts in other languages and null doc_ids
    have no level; repeated rows are each given theirs; labels that are null
    or outside 1 to 4 are left out, readers who disagree share a document's
    weight. Without labels every document gets level 1. `sample` bounds the labelled documents the model is fitted on;
    every document is read whole. One narrow pass, no shuffle of the corpus.
    """
    reader = fit_reader(docs, labels, sample)
    state = (reader.weights.astype(np.float32), reader.shapes, reader.calibration)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("level", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Reader(*state)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                ids, read = [], []
                for i, text in zip(batch.column(0).slice(lo, 500).to_pylist(), batch.column(1).slice(lo, 500).to_pylist(), strict=True):
                    if text is None or i is None or len(text) < 2 * least_words - 1 or len(text.split()) < least_words:
                        continue
                    s = sentences(text)
                    if s and is_english([w for x in s for w in x]):
                        ids.append(i)
                        read.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(ids, type=batch.schema.field(0).type), pa.array(model.levels(read), type=pa.int32())], names=["doc_id", "level"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)


def p8_found(spark, d):
    return reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"))


def p8_profile(spark, d):
    """Documents per kind and level."""
    levels = p8_found(spark, d)
    kinds = table(spark, d, "documents").select("doc_id", "doc_kind")
    return levels.join(kinds, "doc_id").groupBy("doc_kind", "level").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {"p8_found": p8_found, "p8_profile": p8_profile}
SQL: dict[str, str] = {}
