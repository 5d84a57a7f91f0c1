"""Toxicity: logistic regression on words and their beginnings, held steady under swaps of identity terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from invoicelake.llm.common import hash_spans, slices, small_batches, stored, text_bytes, with_columns_by

#: Labelled rows of each class that a model is fitted on at most, and features that it has at most.
SAMPLE_PER_CLASS, FEATURES = 3000, 4000
#: Bytes of the beginnings of words that are features beside the words.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
# Identity terms; a term is swapped with the others of its line.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "transgender"),
    ("musulmán", "cristiano", "judío", "hindú"),
    ("mujer", "hombre"),
    ("musulman", "chrétien", "juif", "hindou"),
    ("femme", "homme"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch"),
    ("frau", "mann"),
)
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and beginnings of texts, and the number of their text. Words are runs of letters."""
    raw, starts = text_bytes(pc.utf8_lower(texts))
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = _LETTERS[raw]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    first = np.flatnonzero(letter & (edge[:n] | np.concatenate(([True], ~letter[:-1]))))
    end = np.flatnonzero(letter & (edge[1:] | np.concatenate((~letter[1:], [True])))) + 1
    text = np.searchsorted(starts, first, side="right") - 1
    hashes, owners = [hash_spans(raw, first, end)], [text]
    for k in BEGINNINGS:
        long = end - first > k
        hashes.append(hash_spans(raw, first[long], first[long] + k) + np.uint64(k))
        owners.append(text[long])
    return np.concatenate(hashes), np.concatenate(owners)


def _swaps() -> tuple[re.Pattern, dict[str, str]]:
    following = {t: row[(k + 1) % len(row)] for row in IDENTITY_TERMS for k, t in enumerate(row)}
    return re.compile(r"\b(" + "|".join(sorted(following, key=len, reverse=True)) + r")\b"), following


def swapped_sentences(text: str) -> Iterator[tuple[str, str]]:
    """Sentences with identity terms, in lower case, each with its counterfactual: every term replaced by the next."""
    pattern, following = _swaps()
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text.lower()):
        if pattern.search(sentence):
            yield sentence, pattern.sub(lambda m: following[m[1]], sentence)


@dataclass
class Model:
    """Weights of features by hash (sorted), and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.hashes):
            hashes, owner = features_of(texts)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            pairs = np.unique(owner[hit] * len(self.hashes) + at[hit])
            total += np.bincount(pairs // len(self.hashes), self.weights[pairs % len(self.hashes)], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(
    rows: np.ndarray, columns: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, swaps: tuple, penalty: float
) -> tuple[np.ndarray, float]:
    """Weighted logistic regression over (row, column) pairs of ones, by Adam over all rows in each step.

    `swaps` are (pair, column, sign, count): each pair's score change is a sum of signed weights; its square is
    penalised, as often as the pair occurs.
    """
    pair, place, sign, often = swaps
    n_pairs = int(pair.max()) + 1 if len(pair) else 0
    often = often / often.sum() if n_pairs else often
    w, bias = np.zeros(width), float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    m, v, weight = np.zeros(width + 1), np.zeros(width + 1), weight / weight.sum()
    for step in range(1, 401):
        z = bias + np.bincount(rows, w[columns], len(y))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.bincount(columns, error[rows], width) + 2e-6 * w
        if n_pairs:
            change = np.bincount(pair, sign * w[place], n_pairs) * often
            gradient += 2 * penalty * np.bincount(place, sign * change[pair], width)
        g = np.append(gradient, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, features: int = FEATURES, penalty: float = 1.0
) -> Model:
    """A model of `labels.toxic` on texts of `docs`, from at most `per_class` labelled rows of each class.

    Only features that toxic rows have more than twice as often count, so that long clean passages in a toxic text
    don't outweigh it. The sample takes the rows with the smallest hash of doc_id, so it is the same in every run; its classes are
    weighted back to their shares of all labels. Rows without a label, id or text don't count. Which features count is
    found by Spark over the sample (document counts by class); only those, at most `features`, come to the driver.
    Without rows of both classes the model is a constant, the share of toxic rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id IS NOT NULL AND toxic IN (0, 1)"
    )
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        n, hits = sum(shares.values()), shares.get(1, 0)
        share = (hits + 0.5) / (n + 1) if n else 0.05
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    picked = [
        known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)
    ]
    texts = (
        docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
        .join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # at most 2 * per_class rows
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                hashes, owner = features_of(part.column(1))
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
                take = pa.array(owner[new])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(2).take(take), pa.array(hashes[new].view(np.int64))],
                    names=["doc_id", "toxic", "feature"],
                )

    # rows that are repeated count once, as their ids do
    made = stored(texts.mapInArrow(extract, "doc_id bigint, toxic int, feature bigint").distinct(), "toxicity-features")
    size = made.groupBy().agg(*(F.countDistinct(F.when(F.col("toxic") == k, F.col("doc_id"))).alias(f"n{k}") for k in (0, 1)))
    n0, n1 = size.first()
    a, b = F.col("in1") / F.lit(float(max(n1, 1))), F.col("in0") / F.lit(float(max(n0, 1)))
    share = (F.col("in0") + F.col("in1")) / F.lit(float(max(n0 + n1, 1)))
    chosen = (
        made.groupBy("feature")
        .agg(*(F.sum((F.col("toxic") == k).cast("int")).alias(f"in{k}") for k in (0, 1)))
        .where("in0 + in1 >= 2")
        .where(a > 2 * b)
        .select("feature", (F.pow(a - b, 2) / (share * (1 - share) + 1e-4)).alias("strength"))
        .orderBy(F.desc("strength"), "feature")
        .limit(features)
        .select("feature")
    )
    hashes = np.sort(np.array([r[0] for r in chosen.collect()], np.int64).view(np.uint64))
    if not len(hashes):
        share1 = shares[1] / (shares[0] + shares[1])
        return Model(hashes, np.zeros(0), float(np.log(share1 / (1 - share1))))
    table = spark.createDataFrame([(int(x),) for x in hashes.view(np.int64)], "feature bigint")
    data = (
        made.join(F.broadcast(table), "feature", "left_semi")
        .groupBy("doc_id", "toxic")
        .agg(F.collect_set("feature").alias("features"))
        .collect()
    )
    bare = (
        made.groupBy("doc_id", "toxic").count().select("doc_id", "toxic").collect()
    )
    have = {(r["doc_id"], r["toxic"]): r["features"] for r in data}
    y = np.array([r["toxic"] for r in bare], float)
    found = [np.searchsorted(hashes, np.array(have.get((r["doc_id"], r["toxic"]), []), np.int64).view(np.uint64)) for r in bare]
    rows = np.repeat(np.arange(len(bare)), [len(x) for x in found])
    columns = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
    weight = np.where(y == 1, shares[1] / max(n1, 1), shares[0] / max(n0, 1))

    def counterfactual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [p for t in batch.column(1).to_pylist() for p in swapped_sentences(t)]
            changes: dict[tuple[int, int], int] = {}
            out: list[tuple[str, int]] = []
            for k, sign in ((0, 1), (1, -1)):
                h, owner = features_of(pa.array([p[k] for p in pairs], pa.string()))
                for o, x in {(int(o), int(x)) for o, x in zip(owner, h.view(np.int64), strict=True)}:
                    changes[o, x] = changes.get((o, x), 0) + sign
            by_pair: dict[int, list[str]] = {}
            for (o, x), sign in sorted(changes.items()):
                at = np.searchsorted(hashes, np.int64(x).view(np.uint64))
                if sign and at < len(hashes) and hashes[at] == np.int64(x).view(np.uint64):
                    by_pair.setdefault(o, []).append(f"{at}:{sign}")
            out = [(",".join(v), 1) for v in by_pair.values()]
            yield pa.RecordBatch.from_pydict(
                {"change": pa.array([x[0] for x in out], pa.string()), "n": pa.array([x[1] for x in out], pa.int64())}
            )

    # Score changes are few distinct sets of signed features, counted by Spark; all come from the bounded sample.
    swaps = (
        texts.select("doc_id", "text").mapInArrow(counterfactual, "change string, n bigint")
        .groupBy("change").agg(F.sum("n").alias("n")).orderBy("change").collect()
    )
    pair, place, sign = [], [], []
    for k, r in enumerate(swaps):
        for part in r["change"].split(","):
            at, s = part.split(":")
            pair.append(k)
            place.append(int(at))
            sign.append(float(s))
    counts = np.array([r["n"] for r in swaps], float)
    signed = (np.array(pair, np.int64), np.array(place, np.int64), np.array(sign), counts)
    w, bias = fit(rows, columns, y, weight, len(hashes), signed, penalty)
    return Model(hashes, w, bias)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 of each whole text; null and empty texts get the model's score of no words.

    A column named `into` is replaced, other columns and repeated rows pass. Row by row: no shuffle.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(model.score(texts))]

    return with_columns_by(docs, text, [T.StructField(into, T.DoubleType())], compute)


def held_out(column: str = "doc_id"):
    """Whether a row's label must not be learned: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def train_on_tables(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labels that may be learned."""
    return train(docs, labels.where(~held_out()))
