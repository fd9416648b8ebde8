"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is good or bad. A line's features, and those of the lines before and after
it, give its node score; a 2 x 2 table scores neighbouring labels. Forward-backward gives each line's
probability of being good; the document's score is their mean, weighted by the lines' bytes.

The field is fitted to a bounded, documented sample of labelled documents, every line of which takes
its document's label; there long documents are cut into chains of ``CHAIN`` lines. Scores run the
whole chain of whole texts, in lockstep over the documents of a batch.

Lines are parts between line breaks that hold a word (a run of bytes other than white space). A text
without any, null or empty, scores the share of label 1 in the sample. If the sample has one label
only, every text scores that share; without labelled documents it is 0.5. Repeated rows score alike; an empty table gives no rows. Other
columns stay, one with the name of a new column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agorametrics.llm.common import lists, mix, pieces, put, raw, spans, word_hashes

SAMPLE = 6_000  # labelled documents a fit reads at most
CHAIN = 32  # lines of a chain while fitting
OWN = 11  # features of a line by itself

_BLANK = np.zeros(256, dtype=bool)
_BLANK[0x09:0x0E] = _BLANK[0x20] = True


def _bytes(chars: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(chars)] = True
    return found


_UPPER = _bytes(bytes(range(0x41, 0x5B)))
_LETTER = _bytes(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
_DIGIT = _bytes(b"0123456789")
_SYMBOL = _bytes(b"#*$%&|<>@^~_=+{}[]\\/")
_SHOUT = _bytes(b"!?")
_POINT = _bytes(b".,;:")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of a line's, the former's and the next one's features, no former, no next, bias
    steps: np.ndarray  # 2 x 2, bad first
    prior: float


def _repeats(of: np.ndarray, what: np.ndarray) -> np.ndarray:
    """True where the same (of, what) stood before; ``of`` ascends."""
    order = np.lexsort((np.arange(of.size), what, of))
    same = np.zeros(of.size, dtype=bool)
    same[order[1:]] = (what[order[1:]] == what[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    return same


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text of each line with a word, its bytes, and its features."""
    starts, ends = spans(data != 0x0A, offsets)
    w_starts, w_ends = spans(~_BLANK[data], offsets)
    of = np.searchsorted(starts, w_starts, side="right") - 1
    n_words = np.bincount(of, minlength=starts.size)
    keep = n_words > 0
    starts, ends, of = starts[keep], ends[keep], (np.cumsum(keep) - 1)[of]
    n_words = n_words[keep].astype(float)
    if not starts.size:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, OWN))
    text = np.searchsorted(offsets, starts, side="right") - 1
    size = (ends - starts).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(table[data])])
        return upto[ends] - upto[starts]

    letters = share(_LETTER)
    hashes = word_hashes(data, w_starts, w_ends)
    again = np.zeros(of.size, dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    known = _repeats(of, hashes)
    whole = np.add.reduceat(mix(hashes + np.arange(of.size, dtype=np.uint64) - np.searchsorted(of, of).astype(np.uint64)),
                            np.searchsorted(of, np.arange(starts.size)))
    features = np.column_stack([
        np.sqrt(share(_SYMBOL) / size), share(_UPPER) / np.maximum(letters, 1), np.sqrt(share(_SHOUT) / size),
        share(_DIGIT) / size, share(_POINT) / size, np.bincount(of, weights=again, minlength=starts.size) / n_words,
        np.bincount(of, weights=known, minlength=starts.size) / n_words, _repeats(text, whole),
        np.log1p(n_words) / 5, letters / n_words / 10, letters / size])
    return text, size, features


def inputs(text: np.ndarray, own: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features of each line with those of its neighbours."""
    x = (own - mean) / scale
    out = np.zeros((len(x), 3 * OWN + 3))
    out[:, :OWN], out[:, -1] = x, 1
    joined = text[1:] == text[:-1]
    out[1:, OWN:2 * OWN] = x[:-1] * joined[:, None]
    out[:-1, 2 * OWN:3 * OWN] = x[1:] * joined[:, None]
    if len(x):
        out[:, -3], out[:, -2] = 1, 1
        out[1:, -3] -= joined
        out[:-1, -2] -= joined
    return out


def marginals(z: np.ndarray, chain: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and of each line the joint probabilities of its and the former's label.

    All chains go forward together, one line at a time; finished ones drop out.
    """
    if not z.size:
        return np.zeros(0), np.zeros((0, 2, 2))
    first = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    length = np.diff(np.append(first, z.size))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    good = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    node = np.column_stack([1 - good, good])
    move = np.exp(steps - steps.max())
    fore, back = np.empty_like(node), np.ones_like(node)
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]))]
    fore[first] = node[first] / node[first].sum(1, keepdims=True)
    for t in range(1, len(active)):
        at = first[:active[t]] + t
        now = (fore[at - 1] @ move) * node[at]
        fore[at] = now / now.sum(1, keepdims=True)
    for t in range(len(active) - 1, 0, -1):
        at = first[:active[t]] + t
        now = (node[at] * back[at]) @ move.T
        back[at - 1] = now / now.sum(1, keepdims=True)
    both = fore * back
    joint = np.zeros((z.size, 2, 2))
    inner = np.flatnonzero(np.concatenate([[False], chain[1:] == chain[:-1]]))
    joint[inner] = fore[inner - 1][:, :, None] * move[None] * (node[inner] * back[inner])[:, None, :]
    joint[inner] /= joint[inner].sum((1, 2), keepdims=True)
    return both[:, 1] / both.sum(1), joint


def train(text: np.ndarray, own: np.ndarray, y: np.ndarray, rounds: int = 200, penalty: float = 1e-3) -> Model:
    """Fit to lines (their text ascending, their features, their label) by gradient ascent."""
    mean, scale = own.mean(0), own.std(0) + 1e-3
    x = inputs(text, own, mean, scale)
    place = np.arange(text.size) - np.searchsorted(text, text)
    chain = np.cumsum(np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] % CHAIN == 0)]))
    weight = 1 / np.bincount(text)[text]  # every document counts alike
    seen = np.zeros((text.size, 2, 2))
    inner = np.flatnonzero(np.concatenate([[False], chain[1:] == chain[:-1]]))
    seen[inner, y[inner], y[inner]] = 1
    total = weight.sum()
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        good, joint = marginals(x @ theta[:-4], chain, theta[-4:].reshape(2, 2))
        grad = np.concatenate([x.T @ (weight * (y - good)), ((seen - joint) * weight[:, None, None]).sum(0).ravel()]) / total - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), 0.5)


def fit(sample: DataFrame) -> Model:
    """Fit to text and y of a bounded sample: its lines' features come to the driver, not its texts."""

    def run(batches):
        for batch in pieces(batches):
            text, size, own = lines_of(*raw(batch.column(0)))
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            flat = pa.array(own.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(1), lists(flat, cut * OWN)], ["y", "own"])

    rows = sample.select("text", F.col("y").cast("long")).mapInArrow(run, "y long, own array<float>").toArrow()
    label = rows.column("y").to_numpy()
    prior = float(label.mean()) if label.size else 0.5
    own = np.concatenate([c.values.to_numpy() for c in rows.column("own").chunks] or [np.zeros(0, np.float32)]).reshape(-1, OWN).astype(float)
    n = rows.column("own").combine_chunks().value_lengths().to_numpy() // OWN if label.size else label
    text = np.repeat(np.arange(label.size), n)
    if prior in (0.0, 1.0) or not text.size:
        return Model(np.zeros(OWN), np.ones(OWN), np.zeros(3 * OWN + 3), np.zeros((2, 2)), prior)
    text = np.unique(text, return_inverse=True)[1]
    model = train(text, own, np.repeat(label, n))
    model.prior = prior
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", lines: str | None = None) -> DataFrame:
    """``docs`` with the quality score; ``lines`` names a column for P(good) of each line with a word."""
    new = [T.StructField(out, T.DoubleType())] + ([T.StructField(lines, T.ArrayType(T.DoubleType()))] if lines else [])
    kind = T.StructType([f for f in docs.schema if f.name not in (out, lines)] + new)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, own = to_arrow_schema(kind), shared.value
        for batch in pieces(batches, text):
            of, size, features = lines_of(*raw(batch.column(batch.schema.get_field_index(text))))
            good = np.full(of.size, own.prior)
            if own.weights.any():
                good, _ = marginals(inputs(of, features, own.mean, own.scale) @ own.weights, of, own.steps)
            bytes_ = np.bincount(of, weights=size, minlength=batch.num_rows)
            mean = np.bincount(of, weights=size * good, minlength=batch.num_rows) / np.maximum(bytes_, 1)
            columns = {out: pa.array(np.clip(np.where(bytes_ > 0, mean, own.prior), 0, 1))}
            if lines:
                columns[lines] = lists(pa.array(good), np.searchsorted(of, np.arange(batch.num_rows + 1))).cast(schema.field(lines).type)
            yield put(batch, schema, **columns)

    return docs.mapInArrow(run, kind)
