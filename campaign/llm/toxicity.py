"""Toxicity: a support vector machine on a gapped subsequence kernel with Nystroem landmarks.

A text becomes symbols: white-space separated tokens with everything but letters taken out and
lower-cased (`id*iot` gives `idiot`), runs of one-letter tokens joined (`i d i o t`), and one space symbol
before, between and after them. An *example* is a window of WINDOW consecutive words. Its features are its
subsequences of four symbols that span at most six, spaces included, each weighing DECAY per symbol skipped
and hashed into one of FEATURES places. The kernel of two windows is the product of these vectors, each
divided by the root of its summed squared weights, so inserted and dropped characters lower it but little.

Only whole texts are labelled. So a machine is first fitted to the windows of each labelled text that hold
its most telling words, and then ROUNDS times also to the window that the last machine puts highest: those of
toxic texts (if above 0) speak for toxicity, those of clean texts against it.

Nystroem: windows are compared with landmarks only, and a linear SVM is trained in that space. Its
decision is a weighted sum of kernels with the landmarks, so it equals one product with a fixed
vector over subsequences; that vector is what tasks apply to every window of the corpus. A text scores
by its TOP highest windows (each of another stretch of words), through a logistic curve fitted to labelled texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, utf8
from .shared import cut, small_batches

SYMBOLS = 64  # 0: a space or an end, 1-26: a-z, 27-63: other letters by code point
DECAY = 0.5
FEATURES = 1 << 22
#: offsets of the second, third and fourth symbol
SPANS = ((1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4), (1, 2, 5), (1, 3, 5), (1, 4, 5), (2, 3, 5), (2, 4, 5), (3, 4, 5))
WINDOW = 3
TOP = 3
ROUNDS = 3
LABELLED_ROWS = 8_000
SEED_WORDS = 20_000
LANDMARKS = 256
POOL = 600
RIDGE = 1e-4
#: how far, in standard deviations, a word's toxic rows exceed their share for a window around it to be an example from the start
TELLING = 2.0
_CODE = np.zeros(128, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_SPACE = np.zeros(128, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


class Units(NamedTuple):
    """Symbols with a 0 before, between and after units; the unit of each symbol; the row of each unit."""

    symbols: np.ndarray
    unit: np.ndarray
    row: np.ndarray


def units(raw: np.ndarray) -> Units:
    """Units of some rows of UTF-8 text, each of which ends with a record separator."""
    point = np.frombuffer(raw.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32) if len(raw) else np.zeros(0, np.uint32)
    low = np.minimum(point, 127)
    ascii_ = point < 128
    symbol = np.where(ascii_, _CODE[low], 27 + point % 37).astype(np.int32)
    other = ~ascii_ & ((point < 0xC0) | (point == 0xD7) | (point == 0xF7) | ((point >= 0x2000) & (point < 0x2C00)) | ((point >= 0x3000) & (point < 0x3040)) | (point >= 0x1F000))
    symbol[other] = 0
    space = (ascii_ & _SPACE[low]) | (point == 0xA0) | ((point >= 0x2000) & (point < 0x200C)) | (point == 0x3000)
    row_of = np.cumsum(point == 0x1E) - (point == 0x1E)
    keep = (symbol > 0) | space
    symbol, space, row_of = symbol[keep], space[keep], row_of[keep]
    letter = ~space
    begin = letter.copy()
    begin[1:] &= space[:-1]
    number = np.cumsum(begin) - 1
    number, code, row_of = number[letter], symbol[letter], row_of[letter]
    if not len(code):
        return Units(np.zeros(1, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64))
    size = np.bincount(number)
    row = row_of[np.concatenate([[0], np.cumsum(size)[:-1]])]
    glued = np.zeros(len(size), bool)  # a one-letter unit after another of the same row
    glued[1:] = (size[1:] == 1) & (size[:-1] == 1) & (row[1:] == row[:-1])
    of = np.cumsum(~glued) - 1
    number, row = of[number], row[~glued]
    at = np.arange(len(code)) + number + 1
    symbols = np.zeros(len(code) + len(row) + 1, np.int32)
    symbols[at] = code
    owner = np.zeros(len(symbols), np.int64)
    owner[at] = number
    return Units(symbols, owner, row)


def place(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The hashed feature of four symbols."""
    whole = ((a * SYMBOLS + b) * SYMBOLS + c) * SYMBOLS + d
    return (whole.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - FEATURES.bit_length() + 1)


class Windows(NamedTuple):
    """By window: its first symbol (a space), the end of its symbols, its row, and its number within the row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    number: np.ndarray


def windows(found: Units) -> Windows:
    """All windows of WINDOW consecutive words of a row; a row of fewer words, but not none, is one window."""
    space = np.flatnonzero(found.symbols == 0)
    low, high = np.searchsorted(found.row, found.row, "left"), np.searchsorted(found.row, found.row, "right")
    at = np.arange(len(found.row))
    whole = (at + WINDOW <= high) | (at == low)
    at, low, high = at[whole], low[whole], high[whole]
    return Windows(space[at], space[np.minimum(at + WINDOW, high)] + 1, found.row[at], at - low)


def decisions(found: Units, of: Windows, weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision for every window, from running sums over all symbols."""
    s, dot, square = found.symbols, np.zeros(len(of.start)), np.zeros(len(of.start))
    for reach in sorted({span[-1] for span in SPANS}):
        own = [span for span in SPANS if span[-1] == reach]
        m, decay = len(s) - reach, DECAY ** (reach - 3)
        if m <= 0:
            continue
        value = np.zeros(m)
        for second, third, last in own:
            value += weights[place(s[:m], s[second : m + second], s[third : m + third], s[last : m + last])]
        sums = np.concatenate([[0.0], np.cumsum(value * decay)])
        end = np.maximum(of.end - reach, of.start)
        dot += sums[np.minimum(end, m)] - sums[np.minimum(of.start, m)]
        square += (end - of.start) * (len(own) * decay**2)
    return dot / np.sqrt(np.maximum(square, 1e-9)) + bias


def vectors(examples: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature vectors of windows, given by their symbols, as (window, feature, value) triples."""
    s = np.frombuffer(b"".join(examples), np.uint8).astype(np.int32)
    size = np.array([len(x) for x in examples], np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size
    parts = []
    for second, third, last in SPANS:
        n = np.maximum(size - last, 0)
        row = np.repeat(np.arange(len(size)), n)
        at = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())
        parts.append((row, place(s[at], s[at + second], s[at + third], s[at + last]), np.full(len(row), DECAY ** (last - 3))))
    row, feature, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    square = np.bincount(row, value**2, len(size))
    return row, feature, value / np.sqrt(np.maximum(square, 1e-9))[row]


class Weights(NamedTuple):
    """Weights over subsequences as they travel: those that are not 0, a small part of FEATURES."""

    feature: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, weights: np.ndarray) -> Weights:
        feature = np.flatnonzero(weights).astype(np.int32)
        return cls(feature, weights[feature])

    def whole(self) -> np.ndarray:
        out = np.zeros(FEATURES, np.float32)
        out[self.feature] = self.value
        return out


class Machine(NamedTuple):
    """The landmarks with their weights, the bias, and the same decision as weights over subsequences."""

    landmarks: list[bytes]
    alphas: np.ndarray
    bias: float
    weights: np.ndarray


def kernel(examples: list[bytes], landmarks: list[bytes], block: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernels (examples, landmarks), the landmarks' vectors (features, landmarks) and which features these are."""
    row, feature, value = vectors(landmarks)
    used, column = np.unique(feature, return_inverse=True)
    dense = np.zeros((max(1, len(used)), len(landmarks)), np.float32)
    np.add.at(dense, (column, row), value)
    out = np.zeros((len(examples), len(landmarks)), np.float32)
    for low in range(0, len(examples), block):
        row, feature, value = vectors(examples[low : low + block])
        column = np.minimum(np.searchsorted(used, feature), max(0, len(used) - 1))
        own = np.flatnonzero(used[column] == feature) if len(used) else np.zeros(0, np.int64)
        own = own[np.argsort(row[own], kind="stable")]
        bounds = np.searchsorted(row[own], np.arange(min(block, len(examples) - low) + 1))
        column, value = column[own], value[own].astype(np.float32)
        for k, (first, last) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), low):
            if first < last:
                out[k] = value[first:last] @ dense[column[first:last]]
    return out, dense, used


def spread_out(examples: list[bytes], most: int) -> list[bytes]:
    """Up to `most` examples that are least alike: each next one is that which the kernels with those before explain least."""
    near = kernel(examples, examples)[0].astype(np.float64)
    left, factor, chosen = near.diagonal().copy(), np.zeros((len(examples), most)), []
    for k in range(min(most, len(examples))):
        best = int(left.argmax())
        if left[best] < 1e-6:
            break
        factor[:, k] = (near[:, best] - factor @ factor[best]) / np.sqrt(left[best])
        left -= factor[:, k] ** 2
        left[best] = 0
        chosen.append(best)
    return [examples[k] for k in chosen]


def fit_svm(examples: list[bytes], toxic: np.ndarray, weight: np.ndarray, landmarks: int = LANDMARKS, rounds: int = 400) -> Machine:
    """Squared hinge loss with a ridge, by accelerated gradient steps, in the space of the landmarks.

    `toxic` holds truth values. Landmarks are three quarters toxic examples and one quarter others, each the
    least alike of POOL drawn by a fixed seed. Either label weighs as much as stated in the module.
    """
    if toxic.all() or not toxic.any():
        return Machine([], np.zeros(0), 1.0 if len(toxic) and toxic.all() else -1.0, np.zeros(FEATURES, np.float32))
    rng = np.random.default_rng(0)
    up, down = rng.permutation(np.flatnonzero(toxic)), rng.permutation(np.flatnonzero(~toxic))
    marks = spread_out([examples[k] for k in up[:POOL]], landmarks * 3 // 4) + spread_out([examples[k] for k in down[:POOL]], landmarks // 4)
    near, dense, used = kernel(examples, marks)
    own = kernel(marks, marks)[0].astype(np.float64)
    values, axes = np.linalg.eigh(own + 1e-3 * np.eye(len(marks)))
    half_inverse = axes / np.sqrt(np.maximum(values, 1e-6)) @ axes.T
    x = np.hstack([near @ half_inverse, np.ones((len(examples), 1))])
    sign = np.where(toxic, 1.0, -1.0)
    part = np.where(toxic, 0.4, 0.6) * weight / np.where(toxic, weight[toxic].sum(), weight[~toxic].sum())
    step = 1 / (2 * np.linalg.eigvalsh((x * part[:, None]).T @ x)[-1] + RIDGE)
    w = v = np.zeros(x.shape[1])
    for k in range(rounds):
        slope = x.T @ (-2 * part * sign * np.maximum(0, 1 - sign * (x @ v))) + RIDGE * v
        new = v - step * slope
        v, w = new + k / (k + 3) * (new - w), new
    alphas = half_inverse @ w[:-1]
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = dense @ alphas
    return Machine(marks, alphas, float(w[-1]), weights)


def with_inserted(example: bytes) -> bytes:
    """The window with one letter put into its longest word; which one and where follow from its symbols."""
    words = example.split(b"\0")
    k = max(range(len(words)), key=lambda i: len(words[i]))
    word, seed = words[k], sum(example)
    if len(word) < 2:
        return example
    at = 1 + seed % (len(word) - 1)
    words[k] = word[:at] + bytes([1 + seed % 26]) + word[at:]
    return b"\0".join(words)


def pooled(most: np.ndarray) -> np.ndarray:
    """One number by row from its highest stretches: the first, and a tenth of each further one."""
    return most @ np.array([1.0] + [0.1] * (TOP - 1))


def fit_curve(score: np.ndarray, label: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with a small ridge."""
    if not len(score) or label.min() == label.max():
        return 4.0, 0.0
    center, scale = score.mean(), score.std() + 1e-9
    x = np.stack([(score - center) / scale, np.ones(len(score))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (label - p) - 0.5 * w * np.array([1, 0]))
        w = w + np.clip(move, -2, 2)
    return float(w[0] / scale), float(w[1] - w[0] * center / scale)


def _separated(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The rows with a record separator after each; such a byte inside a text becomes a space."""
    rows = len(bounds) - 1
    out = np.full(len(raw) + rows, 0x1E, np.uint8)
    if len(raw):
        clean = np.where(raw == 0x1E, 32, raw)
        out[np.arange(len(raw)) + np.repeat(np.arange(rows), np.diff(bounds))] = clean
    return out


def _parts(column: pa.Array) -> Iterator[tuple[int, int, Units]]:
    """(first row, rows, units) of parts of a text column; whole rows."""
    raw, bounds = utf8(column)
    for first, last in chunks(bounds, 1 << 19):
        part = bounds[first : last + 1]
        yield first, last - first, units(_separated(raw[part[0] : part[-1]], part - part[0]))


def highest(column: pa.Array, weights: np.ndarray, bias: float) -> tuple[np.ndarray, list[bytes | None]]:
    """By row, the TOP greatest decisions of windows, one of each WINDOW neighbours, and the first one's symbols.

    Where there are fewer the last one repeats; -2 for a row without words.
    """
    out, best = np.full((len(column), TOP), -2.0), [None] * len(column)
    for first, _, found in _parts(column):
        if not len(found.row):
            continue
        of = windows(found)
        f = np.maximum(decisions(found, of, weights, bias), -2)
        stretch = np.flatnonzero(of.number % WINDOW == 0)
        most, row = np.maximum.reduceat(f, stretch), of.row[stretch]
        order = np.lexsort((-most, row))
        row, most = row[order], most[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        out[first + row[rank < TOP], rank[rank < TOP]] = most[rank < TOP]
        count = np.bincount(row)
        for k in range(1, TOP):
            short = first + np.flatnonzero((count > 0) & (count <= k))
            out[short, k] = out[short, k - 1]
        order = np.lexsort((-f, of.row))
        symbols = found.symbols.astype(np.uint8)
        for k in order[np.searchsorted(of.row[order], np.unique(of.row))]:
            best[first + of.row[k]] = symbols[of.start[k] : of.end[k]].tobytes()
    return out, best


def _words(found: Units, rows: int) -> list[list[bytes]]:
    """The words of each row, as symbols."""
    space, symbols = np.flatnonzero(found.symbols == 0), found.symbols.astype(np.uint8)
    low, high = np.searchsorted(found.row, np.arange(rows), "left"), np.searchsorted(found.row, np.arange(rows), "right")
    return [symbols[space[a] + 1 : space[b]].tobytes().split(b"\0") if a < b else [] for a, b in zip(low, high, strict=True)]


def sample(labels: DataFrame, id_col: str = "doc_id", most_rows: int = LABELLED_ROWS) -> DataFrame:
    """About `most_rows` of the labels at most, those with the least hash of the id."""
    share = int((1 << 30) * min(1.0, most_rows / max(1, labels.count())))
    return labels.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share)


class Model(NamedTuple):
    """Weights over subsequences with a bias, and slope and shift of the logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def train(texts: DataFrame, label_col: str = "toxic", text_col: str = "text") -> Model:
    """A model from labelled rows (label 0 or 1; others are left out), as many as sample() leaves.

    The driver gathers a few windows of each of these rows, and the SEED_WORDS words of 3 to 39 letters that most
    of them hold (toxic rows count tenfold), which only choose the first examples. Without rows of either label every text scores low.
    """
    small_batches(texts.sparkSession)
    known = texts.where(F.col(label_col).isin(0, 1)).select(F.col(label_col).cast("int").alias("y"), F.col(text_col).alias("text"))
    known = cut(known.repartition(texts.sparkSession.sparkContext.defaultParallelism))  # sample() bounds it; it is read ROUNDS + 3 times

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[bytes, list[int]] = {}
            labels = batch.column(0).to_pylist()
            for first, rows, found in _parts(batch.column(1)):
                for y, own in zip(labels[first : first + rows], _words(found, rows), strict=True):
                    for u in set(own):
                        if 2 < len(u) < 40:
                            counts.setdefault(u, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["word", "toxic", "clean"])

    counted = known.mapInArrow(spread, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    top = counted.where("toxic + clean > 1").orderBy(F.desc(F.col("toxic") * 10 + F.col("clean")), "word").limit(SEED_WORDS).toPandas()
    up, both = top["toxic"].to_numpy(float), (top["toxic"] + top["clean"]).to_numpy(float)
    telling = dict(zip(top["word"].map(bytes), (up - up.sum() / max(1.0, both.sum()) * both) / np.sqrt(both + 1), strict=True))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows around each row's most telling words."""
        for batch in batches:
            labels, y_out, out = batch.column(0).to_pylist(), [], []
            for first, rows, found in _parts(batch.column(1)):
                for y, own in zip(labels[first : first + rows], _words(found, rows), strict=True):
                    if not own:
                        continue
                    place_of = {u: i for i, u in enumerate(own)}
                    at = [place_of[u] for u in sorted(place_of, key=lambda u: (-telling.get(u, -9.0), u))[:TOP]]
                    # of toxic rows words that tell enough, of clean rows one word that tells most and one by chance
                    at = [at[0], *(i for i in at[1:] if telling.get(own[i], -9.0) >= TELLING)] if y else [at[0], sum(own[len(own) // 2]) * 7919 % len(own)]
                    for k in at:
                        low = max(0, min(k - WINDOW // 2, len(own) - WINDOW))
                        y_out.append(y)
                        out.append(b"\0" + b"\0".join(own[low : low + WINDOW]) + b"\0")
            yield pa.RecordBatch.from_arrays([pa.array(y_out, pa.int32()), pa.array(out, pa.binary())], names=["y", "example"])

    def fitted(examples: Counter) -> Machine:
        """`examples` counts (label, window)."""
        own = sorted(examples.items())
        more = [((1, with_inserted(x)), 0.3 * n) for (y, x), n in own if y]
        windows_, weight = [x for (_, x), _ in own + more], np.array([n for _, n in own + more], float)
        return fit_svm(windows_, np.array([y == 1 for (y, _), _ in own + more], bool), weight)

    def ranked(machine: Machine) -> DataFrame:
        sent, bias = Weights.of(machine.weights), machine.bias

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = sent.whole()
            for batch in batches:
                most, best = highest(batch.column(1), weights, bias)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(most.tolist(), pa.list_(pa.float64())), pa.array(best, pa.binary())], names=["y", "most", "example"])

        return known.mapInArrow(run, "y int, most array<double>, example binary")

    examples = Counter((r["y"], bytes(r["example"])) for r in known.mapInArrow(seeds, "y int, example binary").collect())
    machine = fitted(examples)
    rows = ranked(machine).collect()
    for _ in range(ROUNDS):
        examples.update((r["y"], bytes(r["example"])) for r in rows if r["example"] is not None and (not r["y"] or r["most"][0] > 0))
        machine = fitted(examples)
        rows = ranked(machine).collect()
    slope, shift = fit_curve(pooled(np.array([r["most"] for r in rows], float).reshape(-1, TOP)), np.array([r["y"] for r in rows], float))
    return Model(machine.weights, machine.bias, slope, shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the score, 0 to 1, of every row's whole text; null and empty texts score as a text without words.

    Other columns are not read; rows that repeat each get the same score.
    """
    small_batches(docs.sparkSession)
    sent, bias, slope, shift = Weights.of(model.weights), model.bias, model.slope, model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.whole()
        for batch in batches:
            most, _ = highest(batch.column(1), weights, bias)
            p = 1 / (1 + np.exp(-np.clip(slope * pooled(most) + shift, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
