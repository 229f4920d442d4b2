"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + sum_f w_f x_f + sum_{f<g} <v_f, v_g> x_f x_g); the pairs are summed in linear time as
half of |sum_f x_f v_f|^2 - sum_f x_f^2 |v_f|^2.

Features of a text, as one sparse vector:
- words in lower case (without the signs around them), hashed, log(1 + count), scaled to length 1;
- structure statistics (shares of capitals, digits, signs and blanks, repeated words, repeated lines,
  length of words and lines, …), each cut into steps, one feature per step;
- metadata: columns named by the caller, as number of digits if numeric, else hashed by value.

The model is fitted on a bounded sample of distinct labelled rows (``SAMPLE``) with mini-batch Adam: the sample's
sparse vectors come to the driver, the model goes to the tasks as some 600 KB. Everything
else runs in the scan, without a shuffle. Features that the sample lacks have weight 0.

Null or empty texts have structure features only. Labels missing or of one kind only: every score is the
share of label 1 (0.5 without labels). Rows repeat as given; extra columns are ignored or kept as asked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import KEY, LABELLED, bounded_sample, labelled_keys, rows_of_keys, whole_text

SAMPLE = 6000  # labelled rows to fit on
HASHED = 1 << 14
STEPS = 16  # steps per statistic
STATISTICS = 14
META = 64  # values per metadata column
RANK = 8
EPOCHS = 12
LEAST_UPDATES = 600  # small samples are gone through more often
BATCH = 128
RATE = 0.02
DECAY = 1e-5
SEED = 17
_CACHE = 200_000

_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 new line, 6 sentence sign, 7 other sign
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = (
        1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 5 if _c == "\n" else 4 if _c.isspace()
        else 6 if _c in ".,;:?'\"-()" else 7 if _b > 32 else 0
    )
_KIND[128:] = 1


def _step(value: float) -> int:
    """Share from 0 to 1 to a step, finer near 0."""
    return min(STEPS - 1, int(STEPS * min(1.0, max(0.0, value)) ** 0.5))


def _log_step(value: float) -> int:
    return min(STEPS - 1, int(np.log2(1 + value)))


def statistics(text: bytes, words: list[bytes], n_distinct: int) -> list[int]:
    """The step of each structure statistic."""
    kinds = np.bincount(np.take(_KIND, np.frombuffer(text, np.uint8)), minlength=8) if text else np.zeros(8, np.int64)
    size, letters, n = max(1, len(text)), max(1, int(kinds[1] + kinds[2])), max(1, len(words))
    lines = [x for x in text.split(b"\n") if x]
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":") for x in lines)
    signed = sum(w[-1] in _SIGNS for w in words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [
        _step(kinds[2] / letters),
        _step(kinds[3] / size),
        _step(kinds[6] / size),
        _step(kinds[7] / size),
        _step((kinds[4] + kinds[5]) / size),
        _step(1 - n_distinct / n),
        _step(1 - len(set(lines)) / max(1, len(lines))),
        _step(same / n),
        _step(signed / n),
        _step(ends / max(1, len(lines))),
        _log_step(sum(map(len, words)) / n * 4),
        _log_step(n / max(1, len(lines))),
        _log_step(len(words)),
        _step(text.count(b"|") / n),
    ]


def size_of(n_meta: int) -> int:
    return HASHED + STATISTICS * STEPS + n_meta * META


class Features:
    """Sparse vectors of texts; keeps the slots of words it has met, emptied when there are many."""

    def __init__(self) -> None:
        self.slots: dict[bytes, int] = {}

    def _slot(self, word: bytes) -> int:
        slot = self.slots.get(word)
        if slot is None:
            if len(self.slots) > _CACHE:
                self.slots.clear()
            slot = self.slots[word] = xxhash.xxh64_intdigest(word.strip(_SIGNS), 3) % HASHED
        return slot

    def of(self, text: bytes, meta: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        lowered = Counter(text.lower().split())
        slots = np.fromiter(map(self._slot, lowered), np.int64, len(lowered))
        counts = np.bincount(slots, np.fromiter(lowered.values(), float, len(lowered)), minlength=1)
        used = np.flatnonzero(counts)
        values = np.log1p(counts[used])
        norm = np.sqrt((values**2).sum())
        steps = np.array(statistics(text, words, len(lowered)))
        at = HASHED + STEPS * np.arange(STATISTICS) + steps
        more = [HASHED + STATISTICS * STEPS + META * i + xxhash.xxh64_intdigest(m, 5) % META for i, m in enumerate(meta)]
        index = np.concatenate([used, at, np.array(more, np.int64)])
        extra = np.full(STATISTICS + len(meta), 0.3)
        return index, np.concatenate([values / norm if norm else values, extra])


@dataclass
class Machine:
    """Weights, factors and the bias; ``constant`` replaces the score where there was nothing to learn."""

    w: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK), np.float32))
    bias: float = 0.0
    constant: float | None = None

    def margins(self, index: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One margin per vector; vectors lie behind each other, none is empty."""
        linear = np.add.reduceat(self.w[index] * values, starts)
        part = self.v[index] * values[:, None]
        total = np.add.reduceat(part, starts, axis=0)
        squares = np.add.reduceat((part**2).sum(axis=1), starts)
        return self.bias + linear + 0.5 * ((total**2).sum(axis=1) - squares)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int) -> Machine:
    """Mini-batch Adam on the logistic loss; the same rows in the same order give the same model."""
    if not len(labels) or labels.min() == labels.max():
        return Machine(constant=float(labels.mean()) if len(labels) else 0.5)
    draw = np.random.default_rng(SEED)
    seen = np.zeros(size, bool)
    for index, _ in rows:
        seen[index] = True
    # One table for weight and factors: column 0 is linear.
    theta = np.concatenate([np.zeros((size, 1)), draw.normal(0, 0.05, (size, RANK))], axis=1)
    theta[~seen] = 0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    share = labels.mean()
    bias, step = float(np.log(share / (1 - share))), 0
    epochs = max(EPOCHS, -(-LEAST_UPDATES // -(-len(rows) // BATCH)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = draw.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            lengths = np.array([len(rows[i][0]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            index = np.concatenate([rows[i][0] for i in chosen])
            values = np.concatenate([rows[i][1] for i in chosen])
            v = theta[:, 1:]
            part = v[index] * values[:, None]
            total = np.add.reduceat(part, starts, axis=0)
            squares = np.add.reduceat((part**2).sum(axis=1), starts)
            margin = bias + np.add.reduceat(theta[index, 0] * values, starts) + 0.5 * ((total**2).sum(axis=1) - squares)
            error = (sigmoid(margin) - labels[chosen]) / len(chosen)
            weight = np.repeat(error, lengths) * values
            touched, place = np.unique(index, return_inverse=True)
            rows_grad = np.concatenate(
                [weight[:, None], weight[:, None] * (np.repeat(total, lengths, axis=0) - part)], axis=1
            )
            grad = np.stack([np.bincount(place, g, minlength=len(touched)) for g in rows_grad.T], axis=1)
            grad += DECAY * theta[touched]
            step += 1
            # Moments of untouched features rest until they are met again.
            first[touched] = 0.9 * first[touched] + 0.1 * grad
            second[touched] = 0.999 * second[touched] + 0.001 * grad**2
            scale = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            theta[touched] -= rate * scale * first[touched] / (np.sqrt(second[touched]) + 1e-8)
            bias -= rate * error.sum()
    return Machine(theta[:, 0].astype(np.float32), theta[:, 1:].astype(np.float32), bias)


def metadata(docs: DataFrame, columns: list[str]) -> Column:
    """The metadata of a row as an array of strings."""
    numeric = {n for n, t in docs.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    values = [
        F.when(F.col(c).isNull(), "missing").otherwise(
            F.concat(F.lit("size "), F.length(F.abs(F.col(c)).cast("decimal(38,0)").cast("string")).cast("string"))
            if c in numeric else F.concat(F.lit("is "), F.col(c).cast("string"))
        )
        for c in columns
    ]
    return F.array(*values).cast("array<string>")


def train(docs: DataFrame, labels: DataFrame, label: str, meta: list[str], sample: int = SAMPLE) -> Machine:
    """Fit on at most about ``sample`` of the distinct rows of ``docs`` that have a label in ``labels`` (doc_id, label)."""
    chosen = bounded_sample(labelled_keys(docs, labels, label), sample)
    joined = rows_of_keys(docs, chosen, _text=whole_text(), _meta=metadata(docs, meta))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = Features()
        for frame in frames:
            vectors = [made.of(t.encode(), list(m)) for t, m in zip(frame["_text"], frame["_meta"])]
            yield pd.DataFrame(
                {
                    "key": frame[KEY[0]],
                    "label": frame[LABELLED],
                    "i": [v[0].astype(np.int32).tobytes() for v in vectors],
                    "x": [v[1].astype(np.float32).tobytes() for v in vectors],
                }
            )

    found = joined.mapInPandas(run, "key long, label int, i binary, x binary").distinct().toPandas()
    found = found.sort_values(["key", "i"], kind="stable")
    rows = [
        (np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(float))
        for i, x in zip(found["i"], found["x"])
    ]
    return fit(rows, found["label"].to_numpy(float), size_of(len(meta)))


def scorer(model: Machine):
    """A column function of (text, metadata) that gives the score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made = Features()
        for text, meta in batches:
            if model.constant is not None or not len(text):
                yield pd.Series(np.full(len(text), model.constant if model.constant is not None else 0.5))
                continue
            out, held, size = [], [], 0

            def flush() -> None:
                lengths = [len(i) for i, _ in held]
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
                index = np.concatenate([i for i, _ in held])
                out.append(model.margins(index, np.concatenate([x for _, x in held]).astype(np.float32), starts))
                held.clear()

            for t, m in zip(text, meta):
                held.append(made.of(t.encode(), list(m)))
                size += len(held[-1][0])
                if size > 100_000:
                    flush()
                    size = 0
            if held:
                flush()
            yield pd.Series(sigmoid(np.concatenate(out).astype(float)))

    return score


def with_score(docs: DataFrame, model: Machine, meta: list[str], name: str) -> DataFrame:
    return docs.withColumn(name, scorer(model)(whole_text(), metadata(docs, meta)))
