"""Language identification with a string kernel.

Two texts are as alike as the character n-grams (of 1 to LONGEST characters, words padded by one blank) that both hold:

    k(x, y) = |N(x) and N(y)| / sqrt(|N(x)| |N(y)|)          (N: the set of n-grams; a blended-spectrum presence kernel)

The kernel matrix is approximated by LANDMARKS texts (Nystrom): with K the kernel between the landmarks, a text's features are its kernel
values with the landmarks times K^-1/2, and a ridge regression on them, one against the rest for each language, gives the scores. Since
kernel values are themselves products of a 0/1 row of n-grams with the landmarks' n-grams, the products are taken from the left in training
(texts x n-grams x landmarks x features) and from the right in scoring: n-grams x landmarks x languages is multiplied out once, to one
matrix of n-grams by languages, and a batch of texts is scored by its product with that.

The model learns from a bounded sample: of each language the PER_LANGUAGE labelled rows with the smallest hash, MAX_ROWS of all. Landmarks are taken
from it in turn by language, among the texts of up to LANDMARK_CHARS characters if there are any. Scoring reads every text whole.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import column_or_null, plain, release, staged

LONGEST = 3
PER_LANGUAGE = 512
MAX_ROWS = 8192
LANDMARKS = 192
LANDMARK_CHARS = 20_000
RIDGE = 1e-3
#: Times PER_LANGUAGE rows of a language are expected to be drawn before they are ranked.
DRAWN = 4
#: Characters of a text that are cut into n-grams at a time.
SLICE = 1 << 20
#: Numbers that a product gathers at a time.
CELLS = 1 << 22
#: Kernel eigenvalues below this share of the largest are dropped.
RANK_FLOOR = 1e-6

_LETTER = re.compile("[A-Za-z]")


def held_out(doc_id: Column) -> Column:
    """Whether nothing is learnt from the row: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) or any(map(str.isalpha, text)))


def _letters(part: str) -> np.ndarray:
    """Code points of a text in lower case; 32 for all that is no letter."""
    codes = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ascii_ = codes < 128
    letter = ~ascii_ | ((codes >= 97) & (codes <= 122))
    if not ascii_.all():
        others = [c for c in np.unique(codes[~ascii_]) if not chr(int(c)).isalpha()]
        if others:
            letter &= ~np.isin(codes, np.array(others, np.uint64))
    return np.where(letter, codes, np.uint64(32))


def grams(text: str) -> np.ndarray:
    """The sorted distinct n-grams of a text, as numbers, of which up to three characters of 21 bits fill one each. A run of characters
    that are no letters counts as one blank, and one stands before and after the text."""
    found, ahead = [], np.array([32], np.uint64)
    for at in range(0, len(text), SLICE):
        closing = np.full(int(at + SLICE >= len(text)), 32, np.uint64)
        codes = np.concatenate((ahead, _letters(text[at : at + SLICE]), closing))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = grown = codes[keep]
        ahead = codes[1 - LONGEST :]
        found.append(np.unique(codes))
        for n in range(2, LONGEST + 1):
            grown = (grown[:-1] << np.uint64(21)) | codes[n - 1 :]
            found.append(np.unique(grown))
    return np.unique(np.concatenate(found)) if found else ahead


def kernel(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """k between texts given by their n-grams."""
    known = np.unique(np.concatenate(b)) if b else np.zeros(0, np.uint64)
    right = np.zeros((len(known), len(b)), np.float32)
    for j, g in enumerate(b):
        right[np.searchsorted(known, g), j] = 1 / np.sqrt(len(g))
    return products(a, known, right)


def products(texts: list[np.ndarray], known: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The 0/1 rows of the texts' n-grams (scaled by their number) times right, whose rows are the n-grams known. Texts are taken in
    batches of about CELLS gathered numbers."""
    out = np.zeros((len(texts), right.shape[1]), np.float64)
    if not len(known):
        return out
    at = 0
    while at < len(texts):
        end, cells = at + 1, len(texts[at])
        while end < len(texts) and (cells + len(texts[end])) * right.shape[1] <= CELLS:
            cells += len(texts[end])
            end += 1
        every, sizes = np.concatenate(texts[at:end]), np.array([len(t) for t in texts[at:end]])
        place = np.minimum(np.searchsorted(known, every), len(known) - 1)
        hit = known[place] == every
        place, held = place[hit], np.bincount(np.repeat(np.arange(end - at), sizes)[hit], minlength=end - at)
        some = np.flatnonzero(held)
        if len(some):
            out[at + some] = np.add.reduceat(right[place], (np.cumsum(held) - held)[some], axis=0, dtype=np.float64)
        out[at:end] /= np.sqrt(np.maximum(sizes, 1))[:, None]
        at = end
    return out


def landmarks_of(langs: list[str], lengths: list[int], most: int = LANDMARKS) -> list[int]:
    """Rows taken in turn by language, in the order given; long texts only for a language that has no others."""
    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        rows.setdefault(lang, []).append(i)
    for lang, own in rows.items():
        rows[lang] = [i for i in own if lengths[i] <= LANDMARK_CHARS] or own[:1]
    turn = [(k, lang, i) for lang, own in rows.items() for k, i in enumerate(own)]
    return [i for _, _, i in sorted(turn)[:most]]


class Model:
    """n-grams (sorted), languages and the weights of each n-gram for each language; bias by language."""

    def __init__(self, known: np.ndarray, langs: list[str], weights: np.ndarray, bias: np.ndarray):
        self.known, self.langs, self.weights, self.bias = known, langs, weights, bias

    @classmethod
    def fit(cls, found: list[np.ndarray], lengths: list[int], langs: list[str]) -> Model:
        """Nystrom features and ridge regression on rows given by their n-grams, length and language, landmarks in the rows' order."""
        names = sorted(set(langs))
        chosen = landmarks_of(langs, lengths)
        marks = [found[i] for i in chosen]
        if not marks:
            return cls(np.zeros(0, np.uint64), names, np.zeros((0, len(names)), np.float32), np.zeros(len(names)))
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        good = values > RANK_FLOOR * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        z = kernel(found, marks) @ root
        y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
        # Every language weighs the same, however many rows it has.
        counts = {name: langs.count(name) for name in names}
        share = np.array([1 / (counts[lang] * len(names)) for lang in langs])
        mean_z, mean_y = share @ z, share @ y
        zc, yc = z - mean_z, y - mean_y
        beta = np.linalg.solve((zc * share[:, None]).T @ zc + RIDGE * np.eye(z.shape[1]), (zc * share[:, None]).T @ yc)
        known = np.unique(np.concatenate(marks))
        on_marks = root @ beta
        weights = np.zeros((len(known), len(names)))
        for j, g in enumerate(marks):
            weights[np.searchsorted(known, g)] += on_marks[j] / np.sqrt(len(g))
        return cls(known, names, weights.astype(np.float32), mean_y - mean_z @ beta)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, known=self.known, langs=np.array([x.encode() for x in self.langs], object), weights=self.weights, bias=self.bias)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Model:
        x = np.load(io.BytesIO(data), allow_pickle=True)
        return cls(x["known"], [b.decode() for b in x["langs"]], x["weights"], x["bias"])

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row a text, one column a language: about 1 for the language, -1 for others."""
        return products([grams(t) for t in texts], self.known, self.weights) + self.bias


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = part.column(2).to_pylist()
            found = pa.array([grams(t).astype(np.int64) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(t) for t in texts], pa.int32()), found], names=["place", "lang", "length", "grams"])


def train(docs: DataFrame) -> Model:
    """Fit on labelled rows that are not held out and have a letter.

    Null doc_ids and null languages teach nothing; rows that repeat doc_id and text teach once; rows that tie on the hash of their doc_id are taken
    by doc_id, then by text hash. Only rows whose hash is among about the smallest DRAWN * PER_LANGUAGE of their language are ranked, and
    they without their texts; so a language of many copies may give fewer. Other columns, whatever their names, are ignored.
    """
    bare, own = plain(docs)
    rows = bare.select(F.col(own["doc_id"]).cast("long").alias("doc_id"), F.col(own["text"]).cast("string").alias("text"), column_or_null(bare, own, "lang", "string").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumns({"th": F.xxhash64("text"), "draw": F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)})
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(MAX_ROWS)  # as many rows at most
    drawn = rows.select("lang", "doc_id", "th", "draw").join(F.broadcast(sizes), "lang").filter(F.col("draw") * F.col("rows") <= DRAWN * PER_LANGUAGE)
    once = drawn.groupBy("lang", "doc_id", "th").agg(F.min("draw").alias("draw"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "th"))).filter(F.col("place") <= PER_LANGUAGE)
    chosen = staged(ranked.orderBy("place", "lang").limit(MAX_ROWS).select("place", "lang", "doc_id", "th"), "language-chosen")
    texts = rows.select("lang", "doc_id", "th", "text").join(F.broadcast(chosen), ["lang", "doc_id", "th"]).groupBy("place", "lang").agg(F.min("text").alias("text"))
    sample = staged(texts.mapInArrow(_sampled, "place int, lang string, length int, grams array<long>"), "language-sample", chosen)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "lang"])
        found = [np.asarray(g).astype(np.uint64) for g in rows["grams"]]
        return pd.DataFrame({"model": [Model.fit(found, rows["length"].tolist(), rows["lang"].tolist()).pack()]})

    fitted = sample.groupBy(F.lit("all").alias("one")).applyInPandas(fit, "model binary").first()
    release(sample)
    return Model.unpack(bytes(fitted["model"])) if fitted else Model.fit([], [], [])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row.

    Texts that are null or have no letter are `und` with score 0, and so is every text if no language has been learnt. Of languages that tie the
    first in alphabetical order wins. Repeated rows each keep a row; texts of any length are read whole. Other columns, whatever their
    names, are ignored. No rows in: no rows out.
    """
    data = docs.sparkSession.sparkContext.broadcast(model.pack())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model.unpack(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(1).to_pylist()
                some = [i for i, t in enumerate(texts) if has_letter(t)] if known.langs else []
                best, sure = ["und"] * len(texts), [0.0] * len(texts)
                if some:
                    scores = known.scores([texts[i] for i in some])
                    for i, row in zip(some, scores, strict=True):
                        k = int(row.argmax())
                        best[i], sure[i] = known.langs[k], float(min(max((row[k] + 1) / 2, 0.0), 1.0))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])

    bare, own = plain(docs)
    source = bare.select(column_or_null(bare, own, "doc_id", "long").alias("doc_id"), F.col(own["text"]).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")
