"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of digits, letters and characters beyond ASCII; their features are the word and its first bytes (a few
lengths); the KEPT most telling ones have weights. Labels are of documents, so tokens are labelled first: in a toxic document of the
sample, a token is toxic if one of its features is far more frequent in toxic documents than in others. The field has
two tags; forward-backward gives each token's marginal, and a calibrated logistic turns a document's marginals (the
expected number of toxic tokens, the largest marginal, what the others add, the length) into its score. Runs of tokens with marginals of a half or more
are the offending spans.

All positions of a block of documents are computed at once: tokens stand in rows of ROW, each row's product of transfer
matrices is formed column by column, and the rows of a document are chained. Whole texts are scored.

The fit takes a bounded sample of labelled training rows (SAMPLE documents of each label).

Defined results: null and empty texts, and texts without tokens, have no marginals and get the calibrated score of none.
With labels of one class only, or none, every score is that class's share (0 without labels) and there are no spans. Repeated rows
are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import Words, mix64, text_blocks, utf8, word_bytes
from .learning import class_weights, labelled_rows, logistic, sigmoid

SAMPLE, KEPT, BITS, ROW = 1500, 8192, 20, 64
PREFIXES = (4, 5, 6, 7, 8)
#: Tokens are labelled toxic beyond these odds, if the feature is in this share of the sample's toxic documents, and in
#: LEAST of them at least.
ODDS, SUPPORT, LEAST = 15.0, 0.018, 4
_TOKENS = word_bytes("plain")


def features(words: Words) -> np.ndarray:
    """Features as 64-bit hashes, one row for each kind of feature; 0 stands for none."""
    n = words.ends - words.starts
    out = np.zeros((1 + len(PREFIXES), len(words.starts)), dtype=np.uint64)
    out[0] = words.hashes
    for k, length in enumerate(PREFIXES, 1):
        long = np.flatnonzero(n > length)
        start = words.starts[long]
        out[k, long] = mix64(words.spans(start, start + length) + np.uint64(k))
    return out


class Known:
    """The features that have weights, numbered from 1; all others are 0. Of two in one slot the first has it."""

    def __init__(self, hashes: np.ndarray):
        self.keys = np.concatenate([np.zeros(1, dtype=np.uint64), hashes])
        self.slots = np.zeros(1 << BITS, dtype=np.int32)
        where = hashes & np.uint64((1 << BITS) - 1)
        self.slots[where[::-1]] = np.arange(len(hashes), 0, -1)

    def __reduce__(self):
        return Known, (self.keys[1:],)  # the slots, nearly all of a model's bytes, are made again where it is read

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = self.slots[hashes & np.uint64((1 << BITS) - 1)]
        return np.where(self.keys[at] == hashes, at, 0)


class Grid:
    """Tokens of a block in rows of ROW columns: a document's rows are consecutive, its last row is filled up."""

    def __init__(self, n: np.ndarray):
        self.rows_of = -(-n // ROW)  # rows of each document
        self.first_row = np.concatenate([[0], np.cumsum(self.rows_of)])
        self.rows = int(self.first_row[-1])
        begin = np.concatenate([[0], np.cumsum(n)])[:-1]
        doc = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(doc)) - begin[doc]
        self.cell = (self.first_row[doc] + within // ROW) * ROW + within % ROW
        self.real = np.zeros(self.rows * ROW, dtype=bool)
        self.real[self.cell] = True
        self.real = self.real.reshape(self.rows, ROW)

    def spread(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows * ROW)
        out[self.cell] = values
        return out.reshape(self.rows, ROW)


def forward_backward(grid: Grid, emission: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of tag 1 (by token); with pairs also the sums of neighbours' joint marginals and of first tokens'.

    emission: score of tag 1 less that of tag 0; trans[a, b], start[b]: log potentials. A document's first token has
    `start` in place of a transition.
    """
    e = np.exp(np.clip(grid.spread(emission), -30, 30))
    real, rows = grid.real, grid.rows
    t, s = np.exp(trans), np.exp(start)
    head = np.zeros(rows, dtype=bool)
    head[grid.first_row[:-1][grid.rows_of > 0]] = True
    # Transfer matrix of each row but for a document's first token, whose tag's potentials open its first row.
    m = np.zeros((rows, 2, 2))
    m[:, 0, 0] = m[:, 1, 1] = 1
    for j in range(ROW):
        on = real[:, j] & ~(head & (j == 0))
        a = m[:, :, 0] * t[0, 0] + m[:, :, 1] * t[1, 0]
        b = (m[:, :, 0] * t[0, 1] + m[:, :, 1] * t[1, 1]) * e[:, j, None]
        m = np.where(on[:, None, None], np.stack([a, b], axis=2), m)
        m /= m.sum(axis=(1, 2), keepdims=True)
    # Chain the rows of each document: what enters each row from the left, and from the right.
    left, right = np.ones((rows, 2)), np.ones((rows, 2))
    first = grid.first_row[:-1]
    longest = int(grid.rows_of.max(initial=0))
    order = np.argsort(-grid.rows_of, kind="stable")
    alive = np.searchsorted(-grid.rows_of[order], -np.arange(longest), side="left")  # documents with more rows than k
    opened = np.column_stack([np.full(rows, s[0]), s[1] * e[:, 0]]) if rows else np.ones((0, 2))
    for k in range(longest):
        at = first[order[: alive[k]]] + k
        if k == 0:
            left[at] = opened[at]
        if k + 1 < longest:
            go = at[: alive[k + 1]]
            v = np.einsum("ri,rij->rj", left[go], m[go])
            left[go + 1] = v / v.sum(axis=1, keepdims=True)
    for k in range(longest - 1, 0, -1):
        go = first[order[: alive[k]]] + k
        v = np.einsum("rij,rj->ri", m[go], right[go])
        right[go - 1] = v / v.sum(axis=1, keepdims=True)
    # Within rows: alpha and beta column by column.
    alpha, now = np.empty((rows, ROW, 2)), left
    for j in range(ROW):
        on = real[:, j] & ~(head & (j == 0))
        step = np.column_stack([now[:, 0] * t[0, 0] + now[:, 1] * t[1, 0], (now[:, 0] * t[0, 1] + now[:, 1] * t[1, 1]) * e[:, j]])
        now = np.where(on[:, None], step, now)
        now = now / now.sum(axis=1, keepdims=True)
        alpha[:, j] = now
    marginal, now = np.empty((rows, ROW)), right
    joint, opening = np.zeros((2, 2)), np.zeros(2)
    for j in range(ROW - 1, -1, -1):
        both = alpha[:, j] * now
        marginal[:, j] = both[:, 1] / both.sum(axis=1)
        on = real[:, j] & ~(head & (j == 0))
        weighted = now * np.column_stack([np.ones(rows), e[:, j]])
        if pairs:
            before = alpha[:, j - 1] if j else left
            xi = before[:, :, None] * t * weighted[:, None, :]
            xi /= xi.sum(axis=(1, 2), keepdims=True)
            joint += xi[on].sum(axis=0)
        step = np.column_stack([weighted[:, 0] * t[a, 0] + weighted[:, 1] * t[a, 1] for a in (0, 1)])
        now = np.where(on[:, None], step, now)
        now = now / now.sum(axis=1, keepdims=True)
    out = marginal.reshape(-1)[grid.cell]
    if not pairs:
        return out
    if rows:
        q = marginal[head, 0]
        opening = np.array([(1 - q).sum(), q.sum()])
    return out, joint, opening


def _added(found: np.ndarray, count: np.ndarray, more: np.ndarray, much: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of rising keys and their counts as one."""
    keys = np.union1d(found, more)
    sums = np.zeros(len(keys), dtype=np.int64)
    sums[np.searchsorted(keys, found)] += count
    sums[np.searchsorted(keys, more)] += much
    return keys, sums


class Model:
    """The field and its calibration, fitted on (text, label) rows; number: of all labelled rows, by label."""

    def __init__(self, sample: list[tuple[str, int]], number: dict[int, int], rounds: int = 40):
        total = sum(number.values())
        self.share = number.get(1, 0) / total if total else 0.0
        self.weights = None
        y = np.array([label for _, label in sample], dtype=np.int64)
        if set(y.tolist()) != {0, 1}:
            return
        texts = [t.encode("utf-8", "replace") for t, _ in sample]

        def pieces():
            """Features, numbers of tokens and documents of 250 texts at a time: made twice, so that they are never held together."""
            for at in range(0, len(texts), 250):
                w = Words(texts[at : at + 250], _TOKENS, latin=True)
                yield features(w), w.n[: len(texts[at : at + 250])], w.doc

        # Document frequencies of features among toxic and other documents, summed block by block.
        both = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)) for _ in range(2)]
        for k, (f, n, _) in enumerate(pieces()):
            end = np.cumsum(n)
            for label in (0, 1):
                own = [np.unique(f[:, end[i] - n[i] : end[i]]) for i in np.flatnonzero(y[250 * k : 250 * k + len(n)] == label).tolist()]
                if own:
                    both[label] = _added(*both[label], *np.unique(np.concatenate(own), return_counts=True))
        hashes = np.union1d(both[0][0], both[1][0])
        hashes = hashes[hashes > 0]
        seen = np.zeros((2, len(hashes)))
        for k, (found, count) in enumerate(both):
            seen[k, np.searchsorted(hashes, found[found > 0])] = count[found > 0]
        many = np.array([(y == 0).sum(), (y == 1).sum()], dtype=np.float64)
        odds = np.log((seen[1] + 0.5) / (many[1] + 1)) - np.log((seen[0] + 0.5) / (many[0] + 1))
        weight = np.abs(odds) * np.sqrt(seen.sum(axis=0))
        best = np.argsort(-weight, kind="stable")[:KEPT]
        best = best[seen[:, best].sum(axis=0) >= LEAST]
        self.known = Known(hashes[best])
        toxic = np.zeros(len(best) + 1, dtype=bool)
        toxic[1:] = (odds[best] > np.log(ODDS)) & (seen[1, best] >= max(LEAST, SUPPORT * many[1]))
        size = len(toxic)
        blocks = [(self.known.numbers(f), n, doc) for f, n, doc in pieces()]
        grids = [Grid(n) for _, n, _ in blocks]
        tags = [toxic[f].any(axis=0) & (y[250 * k + doc] == 1) for k, (f, _, doc) in enumerate(blocks)]
        w = np.zeros(size)
        bias, trans, start = np.array([-3.0]), np.zeros((2, 2)), np.zeros(2)
        held = [np.zeros_like(x) for x in (w, bias, trans, start)]  # AdaGrad
        real_pairs, real_first = np.zeros((2, 2)), np.zeros(2)
        for (_, n, _), tag in zip(blocks, tags, strict=True):
            begin = (np.cumsum(n) - n)[n > 0]
            inner = np.ones(len(tag), dtype=bool)
            inner[begin] = False
            at = np.flatnonzero(inner)
            np.add.at(real_pairs, (tag[at - 1].astype(int), tag[at].astype(int)), 1)
            np.add.at(real_first, tag[begin].astype(int), 1)
        tokens = sum(len(t) for t in tags)
        for _ in range(rounds if tokens else 0):
            grads = [2e-3 * w, np.zeros(1), 0.1 * trans - real_pairs, 0.1 * start - real_first]
            for (f, _, _), grid, tag in zip(blocks, grids, tags, strict=True):
                p, joint, opening = forward_backward(grid, w[f].sum(axis=0) + bias[0], trans, start, pairs=True)
                off = p - tag
                grads[0] = grads[0] + np.bincount(f.ravel(), np.broadcast_to(off, f.shape).ravel(), size) * (np.arange(size) > 0)
                grads[1] = grads[1] + off.sum()
                grads[2], grads[3] = grads[2] + joint, grads[3] + opening
            for x, g, h in zip((w, bias, trans, start), grads, held, strict=True):
                h += g * g
                x -= 0.5 * g / (np.sqrt(h) + 1e-6)
        self.weights, self.bias, self.trans, self.start = w, float(bias[0]), trans, start
        summary = np.concatenate([self._summary(texts[at : at + 250])[0] for at in range(0, len(texts), 250)])
        self.calibration = logistic(summary, y.astype(np.float64), class_weights(y, number), ridge=1e-2)

    def marginals(self, texts: list[bytes]) -> tuple[Words, np.ndarray]:
        words = Words(texts, _TOKENS, latin=True)
        f = self.known.numbers(features(words))
        emission = np.full(f.shape[1], self.bias)
        for kind in f:
            emission += self.weights[kind]
        return words, forward_backward(Grid(words.n[: len(texts)]), emission, self.trans, self.start)

    def _summary(self, texts: list[bytes]) -> tuple[np.ndarray, Words, np.ndarray]:
        words, p = self.marginals(texts)
        expected = np.bincount(words.doc, p, len(texts))
        largest = np.zeros(len(texts))
        np.maximum.at(largest, words.doc, p)
        others = np.maximum(expected - largest, 0)
        length = np.log1p(words.n[: len(texts)])
        return np.column_stack([np.log(expected + 0.05), largest, np.log(others + 0.1), length / 5]), words, p

    def score(self, texts: list[bytes], spans: bool = False):
        """Scores; with spans also for each text a list of (start, end, mean marginal), in bytes of its UTF-8."""
        if self.weights is None:
            scores = np.full(len(texts), self.share)
            return (scores, [[] for _ in texts]) if spans else scores
        x, words, p = self._summary(texts)
        scores = sigmoid(np.einsum("ij,j->i", x, self.calibration[:-1]) + self.calibration[-1])
        if not spans:
            return scores
        found: list[list] = [[] for _ in texts]
        hot = np.flatnonzero(p >= 0.5)
        for run in np.split(hot, np.flatnonzero((np.diff(hot) > 1) | (np.diff(words.doc[hot]) > 0)) + 1) if len(hot) else []:
            doc = int(words.doc[run[0]])
            base = int(words.offsets[doc])
            found[doc].append({"start": int(words.starts[run[0]]) - base, "end": int(words.ends[run[-1]]) - base, "marginal": float(p[run].mean())})
        return scores, found


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, score, spans (offsets in bytes of the text's UTF-8)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches):
        for batch in batches:
            for part in text_blocks([batch], 1 << 18):
                scores, spans = model.score(utf8(part.column("text")), spans=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start: long, end: long, marginal: double>>")


def kept(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the limit."""
    # Plain names on the way: columns may have any.
    plain = docs.toDF(*("text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))

    def run(batches):
        for batch in batches:
            for part in text_blocks([batch], 1 << 18):
                yield part.filter(pa.array(model.score(utf8(part.column("text"))) < limit))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def fitted(docs: DataFrame, labels: DataFrame, train_rows: Column, per_class: int = SAMPLE) -> Model:
    """The model, fitted by a task on the bounded sample: the driver gets neither its texts nor what the fit holds."""
    sample, number = labelled_rows(docs, labels, "toxic", train_rows, per_class)

    def fit(batches):
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True)]
        model = Model([(text, int(y)) for _, text, y in sorted(rows, key=lambda r: r[:2])], number)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample.select("doc_id", "text", "y").repartition(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(found["model"]) if found else Model([], number)
