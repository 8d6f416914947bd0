"""Toxicity scores from a factorization machine over hashed terms.

A document's terms are its distinct words and their first bytes, hashed to BUCKETS buckets. The machine's score is

    bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j      (x_i: bucket i is present)

so beside the additive weights w it learns from the factors v which pairs, such as an insult and a group that is named,
weigh more together than alone. The pairwise sum is computed as half of (sum v x)^2 - sum (v x)^2.

Training uses a bounded sample: the MAX_ROWS labelled rows whose doc_id has the smallest hash (all of them in smaller tables). One
task fits the machine on the sample's bucket ids, over every bucket with evidence, however many there are:

* singly: the log-odds of the label with and without the bucket differ by Z_SINGLE standard errors or more;
* in pairs: what the machine of the single buckets leaves unexplained (label minus score, the scores first fitted to the labels by a
  line on the logit) adds up, over the texts that hold both of two buckets, to Z_PAIR standard errors or more. All pairs are tried whose members
  can reach that: a pair's sum is no larger than either member's sum over the texts with a positive (or with a negative) remainder, so
  leaving out buckets below Z_PAIR in both loses no pair, however rare.

The model is a few numbers a bucket (at most BUCKETS of them). Scoring runs over all rows in Arrow batches.
"""

from __future__ import annotations

import io
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import column_or_null, plain, staged

BUCKETS = 1 << 20
MAX_ROWS = 16_384
Z_SINGLE = 3.0
Z_PAIR = 7.0
#: Columns of the blocks in which pairs are tried: 512 of them over MAX_ROWS rows take 32 MB.
BLOCK = 512
FACTORS = 8
STEPS = 200
RATE = 0.05
DECAY = 2e-3
#: Prefix lengths, in bytes of the lower-cased word, that are terms beside the whole word.
PREFIXES = (5, 7)
MEMORY = 1 << 18

_TO_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(word: bytes) -> list[int]:
    """Buckets of a word and of its prefixes."""
    return [zlib.crc32(word) % BUCKETS, *(zlib.crc32(b"%d:" % n + word[:n]) % BUCKETS for n in PREFIXES if len(word) >= n)]


def distinct_words(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(_TO_WORDS).split())


def held_out(doc_id: Column) -> Column:
    """Whether the row's label is never learnt from: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of values."""
    out = np.zeros((len(sizes), *values.shape[1:]), np.float32)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def _places(ids: list[np.ndarray], buckets: np.ndarray) -> list[np.ndarray]:
    """Where each row's ids stand in buckets (sorted); others are left out."""
    if not len(buckets):
        return [np.zeros(0, np.int64) for _ in ids]
    near = [np.minimum(np.searchsorted(buckets, r), len(buckets) - 1) for r in ids]
    return [k[buckets[k] == r] for k, r in zip(near, ids, strict=True)]


def single_evidence(ids: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the rows, how many rows hold each, and the z-score of its log-odds (0 for a bucket of one row)."""
    every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    buckets, place = np.unique(every, return_inverse=True)
    n, positive = len(ids), float(labels.sum())
    held = np.bincount(place, minlength=len(buckets))
    toxic = np.bincount(place, weights=np.repeat(labels, [len(r) for r in ids]), minlength=len(buckets))
    a, b = toxic + 0.5, held - toxic + 0.5
    odds = np.log(a / (positive + 1 - a)) - np.log(b / (n - positive + 1 - b))
    return buckets, held, np.where(held > 1, odds / np.sqrt(1 / a + 1 / b), 0)


def paired_evidence(ids: list[np.ndarray], labels: np.ndarray, expected: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Which of buckets are in a pair in whose rows labels exceed (or fall below) their expected sum by Z_PAIR standard errors or more."""
    found = np.zeros(len(buckets), bool)
    places = _places(ids, buckets)
    who, at = np.repeat(np.arange(len(ids)), [len(r) for r in places]), np.concatenate(places)
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    g, variance = (x.astype(np.float32)[:, None] for x in (labels - expected, expected * (1 - expected)))

    def block(i: int) -> np.ndarray:
        lo, hi = np.searchsorted(at, (i, i + BLOCK))
        x = np.zeros((len(ids), min(BLOCK, len(buckets) - i)), np.float32)
        x[who[lo:hi], at[lo:hi] - i] = 1
        return x

    for i in range(0, len(buckets), BLOCK):
        left = block(i)
        sums, spreads = (left * g).T, (left * variance).T
        for j in range(i, len(buckets), BLOCK):
            right = left if i == j else block(j)
            strong = np.abs(sums @ right) >= Z_PAIR * np.sqrt(np.maximum(spreads @ right, 1.0))
            if i == j:
                np.fill_diagonal(strong, False)
            found[i : i + BLOCK] |= strong.any(axis=1)
            found[j : j + BLOCK] |= strong.any(axis=0)
    return found


def may_pair(ids: list[np.ndarray], labels: np.ndarray, expected: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Which of buckets a pair of Z_PAIR standard errors (of 1 at least) can hold: those whose positive or negative remainders reach it."""
    places = _places(ids, buckets)
    every, rest = np.concatenate(places), np.repeat(labels - expected, [len(r) for r in places])
    up, down = (np.bincount(every, weights=np.maximum(sign * rest, 0), minlength=len(buckets)) for sign in (1, -1))
    return (up >= Z_PAIR) | (down >= Z_PAIR)


def calibration(logits: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The line on the logits that fits the labels best, by Newton's method. The regularised machine is too flat: without the line it leaves
    every text of one label with a remainder of one sign."""
    x = np.stack((np.ones(len(logits)), logits), axis=1)
    line = np.array([0.0, 1.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (labels - p))
        line = line + np.clip(step, -2, 2)
    return line


def learn(ids: list[np.ndarray], labels: np.ndarray) -> Machine:
    """The machine of the buckets with evidence, single or in pairs, its scores calibrated on the rows."""
    buckets, held, z = single_evidence(ids, labels)
    chosen = buckets[np.abs(z) >= Z_SINGLE]
    machine = Machine.fit(chosen, _places(ids, chosen), labels)
    if not len(ids):
        return machine
    machine = machine.scaled(*calibration(machine.logits(_places(ids, chosen)), labels))
    expected = 1 / (1 + np.exp(-np.clip(machine.logits(_places(ids, chosen)), -30, 30)))
    others = buckets[held < len(ids)]
    tried = others[may_pair(ids, labels, expected, others)]
    more = np.union1d(chosen, tried[paired_evidence(ids, labels, expected, tried)]) if len(tried) else chosen
    if len(more) == len(chosen):
        return machine
    machine = Machine.fit(more, _places(ids, more), labels)
    return machine.scaled(*calibration(machine.logits(_places(ids, more)), labels))


class Machine:
    """A fitted factorization machine; buckets are sorted."""

    def __init__(self, buckets: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.buckets, self.bias, self.w, self.v = buckets, bias, w, v
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[buckets] = np.arange(len(buckets))
        self.memory: dict[bytes, tuple[int, ...]] = {}

    @classmethod
    def fit(cls, buckets: np.ndarray, rows: list[np.ndarray], labels: np.ndarray) -> Machine:
        """Full-batch logistic loss with Adam; rows hold the places of present buckets, each once."""
        n, p = len(rows), len(buckets)
        sizes = np.array([len(r) for r in rows], np.int64)
        at = np.concatenate(rows).astype(np.int64) if n else np.zeros(0, np.int64)
        who = np.repeat(np.arange(n), sizes)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(at, kind="stable")
        holders, held = who[order], np.bincount(at, minlength=p)
        opens = np.cumsum(held) - held

        def by_row(values: np.ndarray) -> np.ndarray:
            return _sums(values[at], starts, sizes)

        def by_bucket(values: np.ndarray) -> np.ndarray:
            return _sums(values[holders], opens, held)

        y = labels.astype(np.float32)
        rate = min(max(float(y.mean()) if n else 0.0, 1e-3), 1 - 1e-3)
        values = [np.float32(math.log(rate / (1 - rate))), np.zeros(p, np.float32), np.random.default_rng(0).normal(0, 0.05, (p, FACTORS)).astype(np.float32)]
        first, second = [np.zeros_like(a) for a in values], [np.zeros_like(a) for a in values]
        for step in range(1, STEPS + 1 if n else 1):
            bias, w, v = values
            xv = by_row(v)
            score = bias + by_row(w) + 0.5 * ((xv**2).sum(axis=1) - by_row((v**2).sum(axis=1)))
            g = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / n
            xg = by_bucket(g)
            grads = [g.sum(), xg + DECAY / 10 * w, by_bucket(g[:, None] * xv) - xg[:, None] * v + DECAY * v]
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                values[k] = values[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return cls(buckets, float(values[0]), values[1], values[2])

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, buckets=self.buckets, bias=self.bias, w=self.w, v=self.v)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Machine:
        x = np.load(io.BytesIO(data))
        return cls(x["buckets"], float(x["bias"]), x["w"], x["v"])

    def present(self, text: bytes | None) -> list[int]:
        """Places of the model's buckets that a text holds."""
        memory, found = self.memory, set()
        if len(memory) > MEMORY:
            memory.clear()
        for word in distinct_words(text):
            places = memory.get(word)
            if places is None:
                places = memory[word] = tuple(p for p in self.place[terms_of(word)].tolist() if p >= 0)
            if places:
                found.update(places)
        return sorted(found)

    def score(self, text: bytes | None) -> float:
        return self.of(self.present(text))

    def of(self, at: list[int] | np.ndarray) -> float:
        """The score of a text that holds the buckets at these places."""
        return 1 / (1 + math.exp(-min(max(self.logit(at), -30.0), 30.0)))

    def logit(self, at: list[int] | np.ndarray) -> float:
        v = self.v[at]
        return self.bias + float(self.w[at].sum()) + 0.5 * float((v.sum(axis=0) ** 2).sum() - (v**2).sum())

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.logit(r) for r in rows])

    def scaled(self, shift: float, slope: float) -> Machine:
        """The machine whose logits are shift + slope times this one's."""
        slope = max(slope, 1e-3)
        return Machine(self.buckets, float(shift + slope * self.bias), (slope * self.w).astype(np.float32), (math.sqrt(slope) * self.v).astype(np.float32))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids = [sorted({b for w in distinct_words(t) for b in terms_of(w)}) for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["label", "ids"])


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit on the labelled rows that are not held out.

    labels: doc_id and toxic. Null doc_ids and null labels teach nothing; of a doc_id's several labels the largest counts, and of its
    several texts the smallest. Rows that tie on the sample's hash are taken by doc_id. Without any labelled row every text scores the
    same, near 0. Other columns, whatever their names, are ignored.
    """
    marks, at = plain(labels)
    known = marks.select(F.col(at["doc_id"]).cast("long").alias("doc_id"), F.col(at["toxic"]).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS)  # at most MAX_ROWS rows of 12 bytes
    bare, own = plain(docs)
    texts = bare.select(F.col(own["doc_id"]).cast("long").alias("doc_id"), F.col(own["text"]).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = staged(rows.select((F.col("label") > 0).cast("int").alias("label"), "text").mapInArrow(_buckets, "label int, ids array<int>"), "toxicity-sample")

    def fit(sampled: pd.DataFrame) -> pd.DataFrame:
        ids = [np.array(x, np.int64) for x in sampled["ids"]]
        order = sorted(range(len(ids)), key=lambda i: (sampled["label"].iloc[i], ids[i].tobytes()))
        model = learn([ids[i] for i in order], sampled["label"].to_numpy()[order].astype(np.float64))
        return pd.DataFrame({"model": [model.pack()]})

    fitted = rows.groupBy(F.lit("all").alias("one")).applyInPandas(fit, "model binary").first()
    return Machine.unpack(bytes(fitted["model"])) if fitted else learn([], np.zeros(0))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs.

    Only the text counts. Null and blank texts have no terms and score the model's bias. Repeated rows each keep a row; equal texts
    tie. Texts of any length are scored whole. Other columns, whatever their names, are ignored. No rows in: no rows out.
    """
    data = docs.sparkSession.sparkContext.broadcast(model.pack())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.unpack(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = [machine.score(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    bare, own = plain(docs)
    source = bare.select(column_or_null(bare, own, "doc_id", "long").alias("doc_id"), F.col(own["text"]).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double")
