"""Quality scores by attention-based multiple-instance learning.

A text is a bag of passages of 64 words, all of them. Each passage is encoded by shares of
kinds of characters and words in it. A hidden layer reads the encoding, gated attention
gives every passage a weight within its text, and the weighted sum of the hidden layers is
scored: labels are known for texts only, and what a passage counts for is learned from them.

The model is fitted on at most ``TRAIN_TEXTS`` labelled texts, in the order of a hash of the
id, and on all passages of each: the sample ends with the text that brings it to
``TRAIN_PASSAGES`` passages. Both bounds hold for fitting alone and do not grow with the
corpus. Scoring reads every passage of every text.
Only the text is an input. Fitting is seeded, so reruns agree.

Results for odd input: a text without words is one empty passage; rows that repeat an id
get a score each; a null id is never held out and never learned from; without labels of
both kinds every score is the share of label 1 (0.5 with no label).
All passages of a text are scored, however long it is; an empty table gives an empty
result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import whole_text
from tidemark.llm.words import Words, chunks

PASSAGE = 64
TRAIN_TEXTS = 8000
TRAIN_PASSAGES = TRAIN_TEXTS * 256
HIDDEN = 24
ATTENTION = 12
ROUNDS = 30
BATCH_TEXTS = 64
RATE = 0.005
DECAY = 1e-4
SEED = 7
THRESHOLD = 0.3
FOLDS = 5

#: Kinds of bytes whose shares are features.
KINDS = (b"#*$%&|<>", b"!", b".,;:", b"?", b"0123456789", b"@/_=~^", b"()[]{}", bytes(range(0x41, 0x5B)), b"'\"-")
FEATURES = len(KINDS) + 9


def encode_passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and how many passages each text has."""
    words = Words(texts)
    counts = words.counts
    passages = np.maximum(-(-counts // PASSAGE), 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(words)) - words.bounds[owner]
    first = np.cumsum(passages) - passages
    passage = first[owner] + inside // PASSAGE
    total = int(passages.sum())
    n = np.bincount(passage, minlength=total).astype(np.float64)
    lengths = (words.ends - words.starts).astype(np.float64)

    def share(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(passage, values, minlength=total) / np.maximum(of, 1)

    chars = np.bincount(passage, lengths, minlength=total)
    columns = []
    for kind in KINDS:
        is_kind = np.zeros(256, dtype=bool)
        is_kind[list(kind)] = True
        before = np.concatenate(([0], np.cumsum(is_kind[words.data])))
        columns.append(np.sqrt(share(before[words.ends] - before[words.starts], chars)))
    before = np.concatenate(([0], np.cumsum(words.data >= 0xC0)))
    columns.append(share(before[words.ends] - before[words.starts], chars))
    hashes = words.hashes()
    same = np.zeros(len(words))
    if len(words) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    columns.append(share(same, n))
    order = np.lexsort((hashes, passage))
    again = np.zeros(len(words))
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (passage[order[1:]] == passage[order[:-1]])
    columns.append(share(again, n))
    # Words that stood anywhere before in the text, for repeats beyond a passage.
    order = np.lexsort((np.arange(len(words)), hashes, owner))
    known = np.zeros(len(words))
    known[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    pair = np.zeros(len(words))
    pair[1:] = known[1:] * known[:-1]
    columns.append(share(pair, n))
    columns.append(chars / np.maximum(n, 1) / 10)
    columns.append(share(lengths <= 1, n))
    columns.append(share(lengths > 12, n))
    columns.append(np.log1p(n) / 4)
    columns.append(np.log1p(np.repeat(counts, passages)) / 8)
    return np.stack(columns, axis=1).astype(np.float32), passages


class Model:
    """Weights as plain arrays; ``score`` needs nothing else."""

    def __init__(self, features: int, rng: np.random.Generator):
        def normal(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.center, self.scale = np.zeros(features), np.ones(features)
        self.weights = {
            "W": normal(features, HIDDEN),
            "b": np.zeros(HIDDEN),
            "V": normal(HIDDEN, ATTENTION),
            "U": normal(HIDDEN, ATTENTION),
            "w": normal(ATTENTION, 1)[:, 0],
            "c": normal(HIDDEN, 1)[:, 0],
            "d": np.zeros(1),
        }

    def forward(self, rows: np.ndarray, passages: np.ndarray) -> dict:
        p, edge = self.weights, np.cumsum(passages) - passages
        x = np.clip((rows - self.center) / self.scale, -5, 5)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, edge), passages))
        a = e / np.repeat(np.add.reduceat(e, edge), passages)
        z = np.add.reduceat(a[:, None] * h, edge)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y}

    def score(self, rows: np.ndarray, passages: np.ndarray) -> np.ndarray:
        return self.forward(rows, passages)["y"]

    def gradients(self, rows: np.ndarray, passages: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, s = self.weights, self.forward(rows, passages)
        edge = np.cumsum(passages) - passages
        error = (s["y"] - labels) / len(labels)
        to_z = np.repeat(error[:, None] * p["c"], passages, axis=0)
        to_a = (to_z * s["h"]).sum(1)
        # Through the softmax of each text.
        mean = np.repeat(np.add.reduceat(s["a"] * to_a, edge), passages)
        to_e = s["a"] * (to_a - mean)
        to_t = to_e[:, None] * p["w"] * s["g"] * (1 - s["t"] ** 2)
        to_g = to_e[:, None] * p["w"] * s["t"] * s["g"] * (1 - s["g"])
        to_h = s["a"][:, None] * to_z + to_t @ p["V"].T + to_g @ p["U"].T
        to_x = to_h * (1 - s["h"] ** 2)
        return {
            "W": s["x"].T @ to_x,
            "b": to_x.sum(0),
            "V": s["h"].T @ to_t,
            "U": s["h"].T @ to_g,
            "w": (s["t"] * s["g"]).T @ to_e,
            "c": s["z"].T @ error,
            "d": np.array([error.sum()]),
        }


def fit(rows: np.ndarray, passages: np.ndarray, labels: np.ndarray, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(rows.shape[1], rng)
    if len(np.unique(labels)) < 2:
        share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
        model.weights["c"][:] = 0
        model.weights["d"][:] = np.log(share / (1 - share))
        return model
    model.center, model.scale = rows.mean(0), rows.std(0) + 1e-6
    first = np.cumsum(passages) - passages
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    step = 0
    for turn in range(ROUNDS):
        rate = RATE * (1 - turn / ROUNDS) + RATE / 50
        order = rng.permutation(len(labels))
        for begin in range(0, len(order), BATCH_TEXTS):
            some = order[begin : begin + BATCH_TEXTS]
            size = passages[some]
            take = np.repeat(first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            step += 1
            for name, gradient in model.gradients(rows[take], size, labels[some]).items():
                m, v = moment[name]
                gradient = gradient + DECAY * model.weights[name]
                m[...] = 0.9 * m + 0.1 * gradient
                v[...] = 0.999 * v + 0.001 * gradient**2
                model.weights[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def _bag_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in chunks(batch.column("text")):
            part = batch.slice(begin, end - begin)
            passages = np.maximum(-(-Words(part.column("text")).counts // PASSAGE), 1)
            columns = [*(part.column(name) for name in ("doc_id", "label", "digest")), pa.array(passages, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "digest", "passages"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in chunks(batch.column("text")):
            part = batch.slice(begin, end - begin)
            rows, passages = encode_passages(part.column("text"))
            edge = np.concatenate(([0], np.cumsum(passages)))
            bags = [rows[first:last].tobytes() for first, last in zip(edge[:-1], edge[1:])]
            columns = [*(part.column(name) for name in ("doc_id", "label", "digest")), pa.array(bags, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "digest", "bag"])


def held_out(doc_id: str = "doc_id"):
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(remainder == 0, F.lit(False))


def training_bags(
    docs: DataFrame, labels: DataFrame, texts: int = TRAIN_TEXTS, passages: int = TRAIN_PASSAGES
) -> list[tuple[int, int, np.ndarray]]:
    """``doc_id``, ``label`` and the rows of all passages of each text to learn from."""
    usable = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out())
    # At most `texts` rows, in the order of a hash.
    chosen = usable.orderBy(F.md5(F.col("doc_id").cast("string")), "label").limit(texts)
    sample = docs.select("doc_id", whole_text()).join(F.broadcast(chosen), "doc_id")
    sample = sample.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("label").cast("int").alias("label"),
        F.xxhash64("text").alias("digest"),
        "text",
    )
    key = ["doc_id", "label", "digest"]
    named = "doc_id long, label int, digest long"
    sizes = sample.mapInArrow(_bag_sizes, f"{named}, passages long")
    # Rows that repeat a document would exceed the bound.
    rows = sizes.orderBy(F.md5(F.col("doc_id").cast("string")), *key).limit(texts).collect()
    before = np.cumsum([0, *(row["passages"] for row in rows)])
    wanted = Counter(tuple(row[name] for name in key) for row, n in zip(rows, before) if n < passages)
    # Repeated rows are fetched once.
    listed = docs.sparkSession.createDataFrame(list(wanted), named)
    fetched = sample.join(F.broadcast(listed), key).dropDuplicates(key).mapInArrow(_bags, f"{named}, bag binary")
    bags = {tuple(row[name] for name in key): row["bag"] for row in fetched.collect()}
    found = sorted((doc, label, bags[doc, label, digest]) for doc, label, digest in wanted.elements())
    return [(doc, label, np.frombuffer(bag, dtype=np.float32).reshape(-1, FEATURES)) for doc, label, bag in found]


def learn(docs: DataFrame, labels: DataFrame, texts: int = TRAIN_TEXTS, passages: int = TRAIN_PASSAGES) -> Model:
    """Fit on labelled rows (``doc_id``, ``label``) that are not held out."""
    found = training_bags(docs, labels, texts, passages)
    rows = [bag for _, _, bag in found]
    return fit(
        np.concatenate(rows).astype(np.float64) if rows else np.zeros((0, FEATURES)),
        np.array([len(r) for r in rows], dtype=np.int64),
        np.array([label for _, label, _ in found], dtype=np.float64),
    )


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each row of ``docs``."""
    # With its class by value: the workers need no copy of this package.
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pickle.loads(shared.value)
        for batch in batches:
            for begin, end in chunks(batch.column("text")):
                part = batch.slice(begin, end - begin)
                rows, passages = encode_passages(part.column("text"))
                scores = held.score(rows.astype(np.float64), passages)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text())
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
