"""Document quality from a linear-chain conditional random field over lines.

Each line gets shape features (letter case, symbols, word lengths, repetition,
...), those of its neighbours included; a two-state chain (bad, good) scores
the lines of a document together, and the forward-backward marginals, weighted
by line length, average into the document's share of good text. A logistic
curve turns the share into the score.

Labels exist for documents only. Training takes a bounded sample of those that
are there (SAMPLE documents, TRAIN_LINES lines of each and TOTAL_LINES of all, in pieces of CHAIN
spread over the whole text; only the features reach the driver). The lines of good documents are good; those of bad
documents start as bad, and the ones a line model finds clearly good become
good, before the chain is fitted. Scoring covers whole texts in tasks; a text's features are made
and dropped block by block, and its chain goes piece by piece, so that many short lines take
little more memory than their text.

Defined results: null text counts as empty; an empty text is one empty line
and gets a score; repeated rows are scored alike; null ids count as held out;
without labelled documents of both kinds every score is 0.5, and all documents
are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordergate.llm.common import byte_slices, split_words

SAMPLE = 4000       # labelled documents for training
TRAIN_LINES = 512   # lines of each that training uses
CHAIN = 64          # training cuts longer chains here
TOTAL_LINES = 400_000  # lines of the whole sample; beyond, each document gives fewer pieces of CHAIN
BLOCK_LINES = 1 << 15  # lines whose features are held at once
PIECE = 512         # lines of a chain scored step by step
ACCEPT = 0.7

#: Byte classes: 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 exclamation or question mark, 6 other symbol, 0 rest.
CLASSES = np.zeros(256, np.uint8)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58] = 1, 2, 3
CLASSES[list(b".,;:'\"()-")] = 4
CLASSES[list(b"!?")] = 5
CLASSES[list(b"*%#&$|@~^=+<>/\\_{}[]`")] = 6
SHAPES = 12


class Lines:
    """The lines of a large_string column without nulls; features of any run of them."""

    def __init__(self, texts: pa.Array):
        n = len(texts)
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]] if raw else np.empty(0, np.uint8)
        ends = ends - ends[0]
        breaks = np.flatnonzero(self.data == 10)
        self.start = np.sort(np.concatenate([ends[:-1], breaks + 1]))
        self.stop = np.sort(np.concatenate([ends[1:], breaks]))
        lines = np.searchsorted(breaks, ends[1:]) - np.searchsorted(breaks, ends[:-1]) + 1
        self.first = np.concatenate([[0], np.cumsum(lines)])
        self.weight = (self.stop - self.start + 1).astype(np.float64)
        same = self._own(0, len(self.start)).dictionary_encode().indices.to_numpy().astype(np.int64)
        same += len(self.start) * np.repeat(np.arange(n), lines)
        self.again = np.ones(len(self.start), bool)
        self.again[np.unique(same, return_index=True)[1]] = False

    def _bounds(self, a: int, b: int) -> np.ndarray:
        return np.append(self.start[a:b], self.start[b] if b < len(self.start) else len(self.data))

    def _own(self, a: int, b: int) -> pa.Array:
        bounds = self._bounds(a, b)
        part = self.data[bounds[0]:bounds[-1]]
        return pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer((bounds - bounds[0]).astype(np.int64)), pa.py_buffer(part)])

    def features(self, a: int, b: int) -> np.ndarray:
        """Features of lines a to b."""
        bounds = self._bounds(a, b)
        data = self.data[bounds[0]:bounds[-1]]
        start, stop = self.start[a:b] - bounds[0], self.stop[a:b] - bounds[0]
        size = (stop - start).astype(np.float64)
        kind = CLASSES[data]
        begins = data > 32
        begins[1:] &= data[:-1] <= 32
        heads = start[start < len(data)]
        begins[heads] = data[heads] > 32

        def count(mask):
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return (total[stop] - total[start]).astype(np.float64)

        lower, upper, digit, mark, bang, symbol = (count(kind == c) for c in range(1, 7))
        words = count(begins)
        capital = count(begins & (kind == 2))
        distinct, number, at = split_words(self._own(a, b))
        of = np.repeat(np.arange(b - a), np.diff(at))
        pairs = np.unique(of * max(len(distinct), 1) + number)
        different = np.bincount(pairs // max(len(distinct), 1), minlength=b - a)
        short = np.bincount(of, (pc.binary_length(distinct).to_numpy() <= 3)[number], b - a) if len(of) else np.zeros(b - a)
        some = np.maximum(words, 1)
        return np.stack([
            np.log1p(size), upper / (upper + lower + 1), symbol / (size + 1), symbol / some, bang / some, digit / (size + 1),
            np.minimum(size / some, 40) / 10, different / some, capital / some, short / some, mark / some, self.again[a:b],
        ], axis=1)


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its weight, first line of each text and the end) of a
    large_string column without nulls."""
    lines = Lines(texts)
    return lines.features(0, len(lines.start)), lines.weight, lines.first


def chain_inputs(features: np.ndarray, first: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised shapes and their squares, the neighbours' shapes, chain ends and a constant."""
    x = np.clip((features - centre) / scale, -4, 4)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    head, tail = np.zeros(len(x)), np.zeros(len(x))
    head[first[:-1]], tail[first[1:] - 1] = 1, 1
    return np.column_stack([x, x * x, before, after, head, tail, np.ones(len(x))])


def marginals(score: np.ndarray, first: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward for all chains at once, step by step.

    ``score``: log weight of good against bad per line; ``change[i, j]``: log weight of state j
    after i. Returns P(good) per line, expected transitions summed, and the log partition summed."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right") if len(lengths) else np.empty(0, int)
    top = max(0.0, float(change.max()))
    move = np.exp(change - top)
    emit = np.column_stack([np.exp(-np.maximum(score, 0)), np.exp(np.minimum(score, 0))])
    total = np.maximum(score, 0).sum() + top * (lengths - 1).sum()
    alpha, beta, norm = np.empty_like(emit), np.ones_like(emit), np.empty(len(emit))
    for t, k in enumerate(live):
        at = begin[:k] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        norm[at] = a.sum(1)
        alpha[at] = a / norm[at, None]
    pairs = np.zeros((2, 2))
    for t in range(len(live) - 2, -1, -1):
        at = begin[:live[t + 1]] + t
        b = emit[at + 1] * beta[at + 1] / norm[at + 1, None]
        beta[at] = b @ move.T
        pairs += (alpha[at].T @ b) * move
    good = alpha[:, 1] * beta[:, 1]
    return good / (good + alpha[:, 0] * beta[:, 0]), pairs, float(np.log(norm).sum() + total)


def good_lines(score: np.ndarray, first: np.ndarray, change: np.ndarray) -> np.ndarray:
    """P(good) per line as of :func:`marginals`, in memory that does not grow with the length of a chain's lines
    times the states: chains are cut into pieces, whose transfer matrices carry the chain's state across the cuts, and
    then all pieces go step by step."""
    lengths = np.diff(first)
    count = -(-lengths // PIECE)
    chain = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][chain] + k * PIECE
    end = np.minimum(begin + PIECE, first[1:][chain])
    move = np.exp(change - max(0.0, float(change.max())))
    before, after = np.ones((len(chain), 2)), np.ones((len(chain), 2))   # messages into a piece from either side
    cut = np.flatnonzero(count[chain] > 1)
    if len(cut):
        whole = np.concatenate([_transfer(score, begin[p], end[p], k[p] == 0, move) for p in _together(cut, begin, end)])
        for i, m in zip(cut, whole):
            if k[i] + 1 < count[chain[i]]:
                v = before[i] @ m
                before[i + 1] = v / v.sum()
        for i, m in zip(cut[::-1], whole[::-1]):
            if k[i]:
                v = m @ after[i]
                after[i - 1] = v / v.sum()
    out = np.empty(len(score))
    for p in _together(np.arange(len(chain)), begin, end):
        _good(out, score, begin[p], end[p], k[p] == 0, before[p], after[p], move)
    return out


def _together(pieces: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Runs of pieces of about BLOCK_LINES lines."""
    total = np.cumsum((end - begin)[pieces])
    return np.split(pieces, np.searchsorted(total, np.arange(BLOCK_LINES, total[-1], BLOCK_LINES), "right")) if len(pieces) else []


def _weights(score: np.ndarray) -> np.ndarray:
    return np.column_stack([np.exp(-np.maximum(score, 0)), np.exp(np.minimum(score, 0))])


def _order(begin, end):
    """Pieces by falling length, and how many of them are still there at each step."""
    order = np.argsort(begin - end, kind="stable")
    lengths = (end - begin)[order]
    return order, np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right") if len(order) else []


def _transfer(score, begin, end, head, move) -> np.ndarray:
    """Product of a piece's steps, scaled; a chain's first line is entered without one."""
    order, live = _order(begin, end)
    m = np.repeat(np.eye(2)[None], len(begin), 0)
    for t, n in enumerate(live):
        at = begin[order[:n]] + t
        step = m[:n] @ move
        m[:n] = np.where((head[order[:n]] & (t == 0))[:, None, None], m[:n], step) * _weights(score[at])[:, None, :]
        m[:n] /= m[:n].sum((1, 2), keepdims=True)
    out = np.empty_like(m)
    out[order] = m
    return out


def _good(out, score, begin, end, head, before, after, move) -> None:
    """P(good) of the lines of whole pieces, given the messages at their ends."""
    order, live = _order(begin, end)
    lengths = (end - begin)[order]
    base = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    lines = np.repeat(begin[order] - base, lengths) + np.arange(lengths.sum())
    emit = _weights(score[lines])
    alpha, beta = np.empty_like(emit), np.empty_like(emit)
    a = np.where(head[order][:, None], before[order], before[order] @ move)
    for t, n in enumerate(live):
        at = base[:n] + t
        a = (a[:n] if t == 0 else a[:n] @ move) * emit[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    beta[base + lengths - 1] = after[order]
    for t in range(len(live) - 2, -1, -1):
        at = base[:live[t + 1]] + t
        b = (emit[at + 1] * beta[at + 1]) @ move.T
        beta[at] = b / b.sum(1, keepdims=True)
    good = alpha[:, 1] * beta[:, 1]
    out[lines] = good / (good + alpha[:, 0] * beta[:, 0])


def _adam(theta: np.ndarray, gradient, steps: int, rate: float = 0.05) -> np.ndarray:
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, steps + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-8)
    return theta


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    change: np.ndarray
    curve: tuple[float, float]

    def good_share(self, features, weight, first) -> np.ndarray:
        p, _, _ = marginals(chain_inputs(features, first, self.centre, self.scale) @ self.weights, first, self.change)
        return np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])

    def unary(self, lines: Lines) -> np.ndarray:
        """Log weight of good against bad of each line, block by block with a line more on either side."""
        n = len(lines.start)
        out = np.empty(n)
        for a in range(0, n, BLOCK_LINES):
            b = min(n, a + BLOCK_LINES)
            lo, hi = max(0, a - 1), min(n, b + 1)
            inner = lines.first[np.searchsorted(lines.first, lo, "right"):np.searchsorted(lines.first, hi)]
            first = np.concatenate([[lo], inner, [hi]]) - lo
            out[a:b] = (chain_inputs(lines.features(lo, hi), first, self.centre, self.scale) @ self.weights)[a - lo:b - lo]
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        out = [np.empty(0)]
        for _, part in byte_slices(texts):
            lines = Lines(part)
            p = good_lines(self.unary(lines), lines.first, self.change)
            share = np.add.reduceat(p * lines.weight, lines.first[:-1]) / np.add.reduceat(lines.weight, lines.first[:-1])
            out.append(_sigmoid(self.curve[0] * share + self.curve[1]))
        return np.concatenate(out)


def fit(features: np.ndarray, weight: np.ndarray, first: np.ndarray, good: np.ndarray) -> Model:
    """Train on the lines of documents with label ``good`` (one per document)."""
    centre, scale = features.mean(0), features.std(0) + 1e-3
    x = chain_inputs(features, first, centre, scale)
    lines = np.diff(first)
    of = np.repeat(good, lines).astype(np.float64)
    # Lines by themselves, every document with the same weight.
    share = np.repeat(1 / lines, lines) / len(lines)
    alone = _adam(np.zeros(x.shape[1]), lambda w: x.T @ ((_sigmoid(x @ w) - of) * share) + 1e-4 * w, 300)
    state = np.where((of == 0) & (x @ alone > 1.0), 1.0, of)
    # A bad document whose lines all look good keeps them bad.
    state = np.where(np.repeat(np.minimum.reduceat(state, first[:-1]), lines) == 1, of, state)
    cut = np.unique(np.concatenate([first, np.flatnonzero((np.arange(len(x)) - np.repeat(first[:-1], lines)) % CHAIN == 0)]))
    inner = np.setdiff1d(np.arange(len(x) - 1), cut[1:-1] - 1)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[inner].astype(int), state[inner + 1].astype(int)), 1)

    def gradient(theta):
        p, pairs, _ = marginals(x @ theta[:-4], cut, theta[-4:].reshape(2, 2))
        return np.concatenate([x.T @ (p - state), (pairs - seen).ravel()]) / len(x) + 1e-4 * theta
    theta = _adam(np.concatenate([alone, np.zeros(4)]), gradient, 150)
    model = Model(centre, scale, theta[:-4], theta[-4:].reshape(2, 2), (1.0, 0.0))
    z = model.good_share(features, weight, first)
    design = np.column_stack([z, np.ones(len(z))])
    curve = _adam(np.array([4.0, -2.0]), lambda c: design.T @ (_sigmoid(design @ c) - good) / len(z) + 1e-5 * c, 1500)
    model.curve = (float(curve[0]), float(curve[1]))
    return model


def held_out(doc_id) -> F.Column:
    """True for rows that training must not see: crc32 of the id as text is 2 modulo 4, or no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def training_lines(n: int, most: int | None = None) -> np.ndarray:
    """Numbers of the lines that training takes of ``n``, at most ``most`` (TRAIN_LINES, whole pieces): pieces of CHAIN
    with the smallest hashes, in order."""
    most = TRAIN_LINES if most is None else most
    if n <= most:
        return np.arange(n)
    pieces = -(-n // CHAIN)
    h = (np.arange(pieces, dtype=np.uint64) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    taken = np.sort(np.argsort(h ^ (h >> np.uint64(29)), kind="stable")[:most // CHAIN])
    lines = (taken[:, None] * CHAIN + np.arange(CHAIN)).ravel()
    return lines[lines < n]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Fit on those of ``docs`` with labels that have the smallest id hashes; None without both kinds."""
    there = docs.where(~held_out(id_col)).select(F.col(id_col).alias("_id")).distinct()
    known = (labels.where(~held_out(id_col) & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_good"))
             .join(there, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(known), "_id").select("_good", "_text"))  # at most `sample` rows

    def run(batches):
        for batch in batches:
            good, out = batch.column(0).to_pylist(), []
            for row, part in byte_slices(batch.column(1)):
                lines = Lines(part)
                for i, (a, b) in enumerate(zip(lines.first.tolist(), lines.first[1:].tolist())):
                    taken = a + training_lines(b - a)
                    pieces = np.split(taken, np.flatnonzero(np.diff(taken) > 1) + 1)
                    features = np.concatenate([lines.features(int(p[0]), int(p[-1]) + 1) for p in pieces])
                    out.append({"good": int(good[row + i]), "features": features.astype("<f4").tobytes(),
                                "weight": lines.weight[taken].astype("<f4").tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("good", pa.int32()), ("features", pa.binary()), ("weight", pa.binary())]))
    got = rows.mapInArrow(run, "good int, features binary, weight binary").toArrow().to_pydict()
    # The order in which tasks answer must not change the sums.
    got = sorted(zip(got["features"], got["weight"], got["good"]))
    if len({g for *_, g in got}) < 2:
        return None
    lines = np.array([len(w) // 4 for _, w, _ in got])
    most = TRAIN_LINES
    while most > CHAIN and np.minimum(lines, most).sum() > TOTAL_LINES:
        most -= CHAIN
    kept = [training_lines(n, most) for n in lines.tolist()]
    got = [(np.frombuffer(f, "<f4").reshape(-1, SHAPES)[k].tobytes(), np.frombuffer(w, "<f4")[k].tobytes(), g)
           for (f, w, g), k in zip(got, kept)]
    features = np.concatenate([np.frombuffer(f, "<f4") for f, _, _ in got]).reshape(-1, SHAPES).astype(np.float64)
    lines = [len(w) // 4 for _, w, _ in got]
    weight = np.concatenate([np.frombuffer(w, "<f4") for _, w, _ in got]).astype(np.float64)
    return fit(features, weight, np.concatenate([[0], np.cumsum(lines)]), np.array([g for *_, g in got], float))


def score_udf(model: Model | None):
    """Arrow function: text -> score."""
    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.full(len(texts), 0.5) if model is None else model.score(texts))
    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from ACCEPT on)."""
    score = score_udf(train(docs, labels, id_col, text_col, label_col))
    return (docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score(text_col).alias("score"))
            .withColumn("predicted", (F.col("score") >= ACCEPT).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality") -> DataFrame:
    """``docs`` that are predicted good (all columns); all of them where there is no model to judge by."""
    model = train(docs, labels, id_col, text_col, label_col)
    return docs if model is None else docs.where(score_udf(model)(F.col(text_col)) >= ACCEPT)
