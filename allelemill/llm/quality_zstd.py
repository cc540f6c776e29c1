"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

Half of a bounded, documented sample of labelled training rows (SAMPLE documents of each label) builds the two
dictionaries; on the other half a logistic regression calibrates the sizes. A text is compressed with either dictionary;
the difference of the two sizes over their sum says which it resembles, and the sizes over the text's length say how
repetitive it is. Whole texts are compressed.

Defined results: null texts are empty; an empty text has difference and rates of 0 bytes over 1 and gets a score too. With
labels of one class only, or none, all scores are that class's share (0.5 without labels). Repeated rows are scored
alike; extra columns are ignored; labels of unknown documents are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame

from .common import text_blocks, utf8
from .learning import class_weights, labelled_sample, logistic, sigmoid

SAMPLE, DICTIONARY_BYTES, LEVEL, PIECE = 1500, 64 << 10, 3, 2048


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of the texts, cut into pieces; the texts themselves, whole, where there is too little to train one."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(texts)  # too few pieces to train on are little to keep


class Sizes:
    """Compressed sizes with two dictionaries, as features."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = []
        for content in (good, bad):
            held = zstandard.ZstdCompressionDict(content) if content[:4] == b"\x37\xa4\x30\xec" else zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False))

    def features(self, texts: list[bytes]) -> np.ndarray:
        n = np.array([max(1, len(t)) for t in texts], dtype=np.float64)
        a, b = (np.array([len(c.compress(t)) if t else 0 for t in texts], dtype=np.float64) for c in self.both)
        difference = (a - b) / np.maximum(a + b, 1)
        rate, other = np.log((a + 8) / (n + 8)), np.log((b + 8) / (n + 8))
        return np.column_stack([10 * difference, 10 * difference * np.abs(difference), rate, rate * rate, other - rate, (rate < -2.5).astype(float), np.log(n) / 10, difference * np.log(n)])


class Model:
    """Dictionaries and calibration, fitted on (text, label) rows; number: of all labelled rows, by label."""

    def __init__(self, sample: list[tuple[str, int]], number: dict[int, int]):
        total = sum(number.values())
        self.share = number.get(1, 0) / total if total else 0.5
        self.dictionaries: tuple[bytes, bytes] | None = None
        halves = [[(t.encode("utf-8", "replace"), y) for i, (t, y) in enumerate(sample) if i % 2 == k] for k in (0, 1)]
        if all({y for _, y in half} == {0, 1} for half in halves):
            self.dictionaries = tuple(dictionary([t for t, y in halves[0] if y == k]) for k in (1, 0))
            y = np.array([y for _, y in halves[1]], dtype=np.float64)
            x = Sizes(*self.dictionaries).features([t for t, _ in halves[1]])
            self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
            self.weights = logistic((x - self.mean) / self.scale, y, class_weights(y, number), ridge=0.1)

    def scorer(self):
        if self.dictionaries is None:
            return lambda texts: np.full(len(texts), self.share)
        sizes = Sizes(*self.dictionaries)
        return lambda texts: sigmoid(np.einsum("ij,j->i", (sizes.features(texts) - self.mean) / self.scale, self.weights[:-1]) + self.weights[-1]) if texts else np.empty(0)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, score."""

    def run(batches):
        score = model.scorer()
        for batch in batches:
            for part in text_blocks([batch]):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score(utf8(part.column("text"))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def fitted(docs: DataFrame, labels: DataFrame, train_rows: Column, per_class: int = SAMPLE) -> Model:
    return Model(*labelled_sample(docs, labels, "quality", train_rows, per_class))
