"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's probability is logistic in the word features it holds; a document's is the noisy-or of
its sentences, 1 - prod(1 - p). Both are fitted together to the documents' labels, so the model also
says which sentences offend. Features are hashes of whole words, however long, of word starts of four to
seven bytes, since insults are inflected, and of all windows of ``INNER`` bytes inside longer words, which
find the parts of a compound, also in scripts without blanks. Words are those of A-Z lower-cased runs of
digits, letters and characters outside ASCII; a sentence ends at ``.``, ``!``, ``?`` or a line break. What
two features of one word say is in both weights; a feature counts once for each word of a sentence.

The fit reads a bounded, documented sample of labelled documents (``samples.labelled``): rows, and bytes
of their texts, are bounded. Every feature of it that tells the labels apart takes part, there is no limit to
their number. Scores read whole texts. A null or empty text has no sentence and
scores 0, whatever the model. Without any labelled document of one kind, every sentence has the probability
of the kind that is there, so all texts with a word score that. Repeated rows score alike; an empty table
gives no rows. Other columns stay, one with the name of a
new column is replaced. Very long texts are scored whole, by themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agorametrics.llm.common import LOWER, WORD, lists, mix, packed, pieces, put, ragged, raw, spans, word_hashes

SAMPLE = 20_000  # labelled documents a fit reads at most
STARTS = (4, 5, 6, 7)
INNER = 6  # bytes of a window inside a word that is longer
GAIN = 6.0  # twice the logarithm of a likelihood ratio that a feature must reach
SEEN = 3  # documents of label 1 that a feature must be in

_END = np.zeros(256, dtype=bool)
_END[[0x0A, 0x21, 0x2E, 0x3F]] = True
_WORD, _START, _INNER = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass
class Model:
    keys: np.ndarray  # sorted
    weights: np.ndarray
    bias: float


@dataclass
class Words:
    """The words of a piece: each distinct one with its features, and where it stands."""

    features: np.ndarray  # of all distinct words, one after the other
    first: np.ndarray  # where each distinct word's start, one more for the end
    word: np.ndarray  # distinct word of each place
    sentence: np.ndarray  # and its sentence
    text: np.ndarray  # text of each sentence

    def expanded(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the features of these words, and the index of the word each belongs to."""
        size = (self.first[1:] - self.first[:-1])[which]
        return ragged(self.first[which], size), np.repeat(np.arange(which.size), size)


def tokens(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = LOWER[data]
    mask = WORD[low]
    starts, ends = spans(mask, offsets)
    text = np.searchsorted(offsets, starts, side="right") - 1
    mark = np.searchsorted(np.flatnonzero(_END[data]), starts) + text
    new = np.ones(starts.size, dtype=bool)
    new[1:] = (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])
    coded = packed(low, mask, starts, ends).dictionary_encode()
    features, first = features_of(*raw(coded.dictionary))
    return Words(features, first, coded.indices.to_numpy(), np.cumsum(new) - 1, text[new])


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct features of each word: of itself, its starts and its inner windows."""
    size = np.diff(offsets)
    n = size.size
    starts = offsets[:-1]
    keys, of = [mix(word_hashes(data, starts, offsets[1:]) ^ _WORD)], [np.arange(n)]
    for k in STARTS:
        some = np.flatnonzero(size >= k)
        keys.append(mix(word_hashes(data, starts[some], starts[some] + k) ^ _START))
        of.append(some)
    some = np.flatnonzero(size > INNER)
    windows = size[some] - INNER + 1
    at = ragged(starts[some], windows)
    if at.size:
        rolled = np.zeros(at.size, np.uint64)
        for k in range(INNER):
            rolled = mix(rolled * np.uint64(31) + data[at + k].astype(np.uint64) + np.uint64(1))
        keys.append(rolled ^ _INNER)
        of.append(np.repeat(some, windows))
    keys, of = np.concatenate(keys), np.concatenate(of)
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(keys.size, dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return keys[new], np.searchsorted(of[new], np.arange(n + 1))


def feature_counts(sample: DataFrame) -> DataFrame:
    """key, pos, neg: in how many documents of either label a feature occurs."""

    def run(batches):
        for batch in pieces(batches):
            found = tokens(*raw(batch.column(0)))
            y = batch.column(1).to_numpy()
            doc = found.text[found.sentence] if found.word.size else np.zeros(0, np.int64)
            # distinct words of each document, then distinct features
            pairs = np.unique(doc * max(1, found.first.size) + found.word)
            at, of = found.expanded(pairs % max(1, found.first.size))
            keys, doc = found.features[at], (pairs // max(1, found.first.size))[of]
            order = np.lexsort((doc, keys))
            keys, doc = keys[order], doc[order]
            new = np.ones(keys.size, dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
            keys, toxic = keys[new], y[doc[new]]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.zeros(0, np.int64)
            pos = np.add.reduceat(toxic, first) if keys.size else toxic
            n = np.diff(np.append(first, keys.size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[first].view(np.int64)), pa.array(pos, pa.int64()), pa.array(n - pos, pa.int64())], ["key", "pos", "neg"])

    parts = sample.select("text", F.col("y").cast("long")).mapInArrow(run, "key long, pos long, neg long")
    return parts.groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose(counts: DataFrame, pos: int, neg: int, least: float = GAIN) -> np.ndarray:
    """The features that speak for label 1, by the likelihood ratio: all that reach ``least``."""
    share = F.lit(pos / (pos + neg))
    n = F.col("pos") + F.col("neg")
    gain = 2 * (F.col("pos") * F.log(F.col("pos") / (n * share))
                + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (n * (1 - share)))).otherwise(0.0))
    chosen = (counts.where((F.col("pos") >= SEEN) & (F.col("pos") * (1 - share) > 2 * F.col("neg") * share)).select("key", gain.alias("gain"))
              .where(F.col("gain") > least).select("key").toArrow())
    # at most the distinct features of the sample, whose bytes are bounded
    return np.sort(chosen["key"].to_numpy().view(np.uint64))


def bags(sample: DataFrame, keys: np.ndarray) -> list:
    """y, number of sentences, and (sentence, feature) pairs of each document: bounded by the sample."""

    def run(batches):
        for batch in pieces(batches):
            words = tokens(*raw(batch.column(0)))
            sentence, text = words.sentence, words.text
            at = np.searchsorted(keys, words.features)
            at[at == keys.size] = 0
            hit = keys[at] == words.features if keys.size else np.zeros(words.features.size, bool)
            where, token = words.expanded(words.word)
            kept = hit[where]
            which, pair_sentence = at[where[kept]], sentence[token[kept]]
            per_doc = np.bincount(text, minlength=batch.num_rows)
            first = np.cumsum(per_doc) - per_doc
            cut = np.searchsorted(text[pair_sentence], np.arange(batch.num_rows + 1))
            local = (pair_sentence - first[text[pair_sentence]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(per_doc, pa.int64()), lists(pa.array(local), cut), lists(pa.array(which.astype(np.int32)), cut)],
                ["y", "n", "sentence", "feature"])

    return sample.select("text", F.col("y").cast("long")).mapInArrow(
        run, "y long, n long, sentence array<int>, feature array<int>").collect()


def train(rows: list, n_features: int, steps: int = 400, penalty: float = 7e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that fit the noisy-or of the sentences to the labels (Adam on all rows)."""
    y = np.array([r.y for r in rows], float)
    count = np.array([r.n for r in rows], float)
    pair_doc = np.repeat(np.arange(len(rows)), [len(r.feature) for r in rows])
    pair_sentence = np.fromiter((s for r in rows for s in r.sentence), np.int64)
    feature = np.fromiter((f for r in rows for f in r.feature), np.int64)
    new = np.ones(feature.size, dtype=bool)
    new[1:] = (pair_doc[1:] != pair_doc[:-1]) | (pair_sentence[1:] != pair_sentence[:-1])
    sentence, doc = np.cumsum(new) - 1, pair_doc[new]
    cold = count - np.bincount(doc, minlength=len(rows))
    w, b = np.zeros(n_features + 1), np.full(1, -5.0)
    w = np.concatenate([w[:-1], b])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(sentence, weights=w[feature], minlength=doc.size) if doc.size else np.zeros(0)
        none = -(np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(rows)) + cold * np.logaddexp(0, w[-1]))
        none = np.minimum(none, -1e-9)
        slope = np.where(y > 0, -np.exp(none) / -np.expm1(none), 1.0)  # of the log-likelihood by log P(no offence)
        dz = -slope[doc] / (1 + np.exp(-np.clip(z, -60, 60)))
        grad = np.zeros_like(w)
        grad[:-1] = np.bincount(feature, weights=dz[sentence], minlength=n_features)[:n_features]
        grad[-1] = dz.sum() - (slope * cold).sum() / (1 + np.exp(-w[-1]))
        grad /= len(rows)
        grad[:-1] -= penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(sample: DataFrame) -> Model:
    """Fit to text and y of a bounded sample."""
    by = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = by.get(1, 0), by.get(0, 0)
    if not pos or not neg:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 50.0 if pos else -50.0)
    keys = choose(feature_counts(sample), pos, neg)
    weights, bias = train(bags(sample, keys), keys.size)
    return Model(keys, weights, bias)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", spans_out: str = "offending", least: float = 0.3) -> DataFrame:
    """``docs`` with the document's probability, and the sentences of probability ``least`` or more.

    A sentence is given by the bytes of its first word's start and its last word's end in the text.
    """
    kind = T.StructType([f for f in docs.schema if f.name not in (out, spans_out)]
                        + [T.StructField(out, T.DoubleType()), T.StructField(spans_out, SPANS)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, own = to_arrow_schema(kind), shared.value
        for batch in pieces(batches, text):
            data, offsets = raw(batch.column(batch.schema.get_field_index(text)))
            words = tokens(data, offsets)
            sentence, of_text = words.sentence, words.text
            weight = np.zeros(words.first.size - 1)
            if own.keys.size:
                at = np.searchsorted(own.keys, words.features)
                at[at == own.keys.size] = 0
                hit = np.where(own.keys[at] == words.features, own.weights[at], 0.0)
                weight = np.add.reduceat(np.append(hit, 0.0), words.first[:-1]) if weight.size else weight
            z = own.bias + np.bincount(sentence, weights=weight[words.word], minlength=of_text.size)[:of_text.size]
            none = -np.bincount(of_text, weights=np.logaddexp(0, z), minlength=batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            bad = np.flatnonzero(p >= least)
            starts, ends = spans(WORD[LOWER[data]], offsets)
            first = np.searchsorted(sentence, bad)
            last = np.searchsorted(sentence, bad, side="right") - 1
            base = offsets[of_text[bad]]
            fields = [pa.array((starts[first] - base).astype(np.int32)), pa.array((ends[last] - base).astype(np.int32)), pa.array(p[bad])]
            found = pa.StructArray.from_arrays(fields, ["start", "end", "p"])
            cut = np.searchsorted(of_text[bad], np.arange(batch.num_rows + 1))
            yield put(batch, schema, **{out: pa.array(-np.expm1(none)), spans_out: lists(found, cut).cast(schema.field(spans_out).type)})

    return docs.mapInArrow(run, kind)
