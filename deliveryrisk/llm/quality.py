"""Text quality by a linear-chain conditional random field over lines.

Every line is good or bad; its features and those of the lines before and after
it score the states, and a 2 x 2 table scores neighbouring states. A line's
marginal comes from the forward-backward pass; the mean of the marginals of
"good", weighted by line length, is the text's quality, which a logistic curve
turns into the probability of label 1.

The field learns from a bounded sample: at most ``SAMPLE`` labelled texts
outside the held-out fold, chosen by a hash of the id, of at most
``MOST_LINES`` lines each; every line takes its text's label. Scoring reads
every whole text and needs no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliveryrisk.llm.common import crc_mod, find_words, mix, sliced_texts, table

SAMPLE = 6000
MOST_LINES = 500
STEPS = 150
RATE = 0.1
RIDGE = 1e-3
THRESHOLD = 0.3
FEATURES = 15

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#$%&*|~^@<>{}[]\\/_=+`",
    "bang": b"!?",
    "point": b".,;:'\"-()",
    "space": b" \t",
    "wide": bytes(range(128, 256)),
}
_MASKS = {name: np.isin(np.arange(256), list(chars)) for name, chars in _CLASSES.items()}
_SYMBOL_END = _MASKS["symbol"] | _MASKS["bang"]


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of some texts, line lengths, and the number of lines of each text."""
    buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    cut = np.flatnonzero(buf == 10)
    begin, end = np.concatenate(([0], cut + 1)), np.concatenate((cut, [buf.size]))
    lines = np.fromiter((t.count(b"\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    size = (end - begin).astype(np.float64)

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(buf.size + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[end] - total[begin]).astype(np.float64)

    n = {name: per_line(mask[buf]) for name, mask in _MASKS.items()}
    # texts are joined by a space there and by a line feed here: places agree
    w = find_words(texts)
    line = np.searchsorted(end, w.begin)
    owner = np.repeat(np.arange(len(texts)), w.counts).astype(np.uint64)
    words = np.bincount(line, minlength=begin.size).astype(np.float64)
    marked = _SYMBOL_END[buf[w.end - 1]] if w.begin.size else np.zeros(0, bool)
    same = np.zeros(w.begin.size, dtype=bool)
    again = np.zeros(w.begin.size, dtype=bool)
    if w.begin.size > 1:
        together = line[1:] == line[:-1]
        same[1:] = (w.hashes[1:] == w.hashes[:-1]) & together
        pair = mix(w.hashes[1:] * np.uint64(31) + w.hashes[:-1] + (owner[1:] << np.uint64(17)))
        _, first = np.unique(pair, return_index=True)
        again[1:] = True
        again[first + 1] = False
    _, first = np.unique(mix(w.hashes * np.uint64(31) + owner), return_index=True)
    distinct = np.bincount(owner[first].astype(np.int64), minlength=len(texts)) / np.maximum(w.counts, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(line, flags, minlength=begin.size) / np.maximum(words, 1.0)

    length = np.maximum(size, 1.0)
    letters = n["upper"] + n["lower"]
    x = np.stack(
        [
            np.log1p(size) / 5.0,
            n["upper"] / np.maximum(letters, 1.0),
            n["digit"] / length,
            n["symbol"] / length,
            n["bang"] / length,
            n["point"] / length,
            n["space"] / length,
            n["wide"] / length,
            size / np.maximum(words, 1.0) / 10.0,
            share(marked),
            share(same),
            share(again),
            np.repeat(distinct, lines),
            (size == 0).astype(np.float64),
            letters / length,
        ],
        axis=1,
    )
    return x, size, lines


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Features of a line, of the one before and of the one after; zeros beyond a text's ends; a constant."""
    last = np.cumsum(lines) - 1
    first = last - lines + 1
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first], after[last] = 0.0, 0.0
    return np.hstack([x, before, after, np.ones((x.shape[0], 1))])


def passes(score: np.ndarray, lines: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of "good" for every line.

    Texts advance side by side, longest first, one line at a time, so no text
    is padded. ``links[i, j]`` scores state i followed by j.
    """
    forward, back = score.copy(), np.zeros_like(score)
    order = np.argsort(-lines, kind="stable")
    count = lines[order]
    first = (np.cumsum(lines) - lines)[order]
    last = first + count - 1
    for t in range(1, int(count[0]) if count.size else 0):
        at = first[: np.searchsorted(-count, -t, side="left")] + t
        r = forward[at - 1]
        forward[at] += np.logaddexp(links[0, 1], r + links[1, 1]) - np.logaddexp(links[0, 0], r + links[1, 0])
        at = last[: at.size] - t
        r = back[at + 1] + score[at + 1]
        back[at] = np.logaddexp(links[1, 0], r + links[1, 1]) - np.logaddexp(links[0, 0], r + links[0, 1])
    return forward, back


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def line_marginals(x: np.ndarray, lines: np.ndarray, weights: np.ndarray, links: np.ndarray) -> np.ndarray:
    forward, back = passes(x @ weights, lines, links)
    return sigmoid(forward + back)


def text_means(good: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Mean marginal by text, weighted by line length and one for the line's end."""
    owner = np.repeat(np.arange(lines.size), lines)
    total = np.bincount(owner, size + 1.0, minlength=lines.size)
    return np.bincount(owner, good * (size + 1.0), minlength=lines.size) / np.maximum(total, 1.0)


def climb(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam's ascent."""
    at, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for i in range(1, steps + 1):
        g = gradient(at)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        at += rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return at


def train(x: np.ndarray, size: np.ndarray, lines: np.ndarray, label: np.ndarray) -> tuple:
    """Weights, links, feature scale and the curve from mean marginal to probability."""
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = with_neighbours((x - centre) / spread, lines)
    y = np.repeat(label, lines).astype(np.float64)
    last = np.cumsum(lines) - 1
    linked = np.ones(y.size, dtype=bool)
    linked[last] = False
    left = np.flatnonzero(linked)
    state = y[left].astype(np.int64)
    seen = np.zeros((2, 2))
    for i in (0, 1):
        seen[i, i] = (state == i).sum()  # a text's lines share its label
    # every text counts alike, however many lines it has
    weight = np.repeat(1.0 / np.maximum(lines, 1), lines) * y.size / max(lines.size, 1)
    scale = 1.0 / max(y.size, 1)

    def gradient(p: np.ndarray) -> np.ndarray:
        w, links = p[:-4], p[-4:].reshape(2, 2)
        score = z @ w
        forward, back = passes(score, lines, links)
        error = (y - sigmoid(forward + back)) * weight
        r, b = forward[left], score[left + 1] + back[left + 1]
        terms = np.stack([links[0, 0] + 0 * r, links[0, 1] + b, links[1, 0] + r, links[1, 1] + r + b])
        share = np.exp(terms - terms.max(axis=0))
        share /= share.sum(axis=0)
        pair = seen.ravel() - share.sum(axis=1)
        return np.concatenate([error @ z, pair]) * scale - RIDGE * p

    p = climb(gradient, np.zeros(z.shape[1] + 4), STEPS, RATE)
    weights, links = p[:-4], p[-4:].reshape(2, 2)
    mean = text_means(line_marginals(z, lines, weights, links), size, lines)
    curve_in = np.stack([logit(mean), np.ones(mean.size)], axis=1)
    curve = climb(lambda c: (label - sigmoid(curve_in @ c)) @ curve_in / label.size - RIDGE * c, np.array([1.0, 0.0]), 300, 0.05)
    return weights, links, centre, spread, curve


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def score_some(texts: list[bytes], model: tuple) -> np.ndarray:
    weights, links, centre, spread, curve = model
    x, size, lines = line_features(texts)
    z = with_neighbours((x - centre) / spread, lines)
    mean = text_means(line_marginals(z, lines, weights, links), size, lines)
    return sigmoid(curve[0] * logit(mean) + curve[1])


def sample_features(batches):
    """Line features of the sampled texts, packed as bytes."""
    for batch in batches:
        labels = batch.column("quality").to_pylist()
        for lo, _, texts in sliced_texts(batch.column("text")):
            for i, text in enumerate(texts, lo):
                if text.count(b"\n") < MOST_LINES:
                    x, size, _ = line_features([text])
                    packed = pa.array([np.hstack([x, size[:, None]]).astype("<f4").tobytes()], pa.binary())
                    yield pa.RecordBatch.from_pydict({"quality": pa.array([labels[i]], pa.int32()), "x": packed})


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: int = 0) -> tuple | None:
    """The model learnt from labelled rows outside the fold; None where there are none.

    Null labels and ids are left out; an id labelled twice takes its lower label.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != fold))
    chosen = (
        known.groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE)
    )
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # the chosen ids are at most SAMPLE rows
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "quality")
    found = rows.mapInArrow(sample_features, "quality int, x binary").orderBy(F.xxhash64("x")).limit(SAMPLE).collect()
    if not found:
        return None
    parts = [np.frombuffer(r["x"], dtype="<f4").reshape(-1, FEATURES + 1).astype(np.float64) for r in found]
    lines = np.array([p.shape[0] for p in parts], dtype=np.int64)
    packed = np.vstack(parts)
    label = np.array([r["quality"] for r in found], dtype=np.float64)
    return train(packed[:, :-1], packed[:, -1], lines, label)


def with_quality(docs: DataFrame, model: tuple | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that a text is good.

    Null counts as empty: one empty line. Without a model every text scores
    0.5. Rows are scored one by one; a column named ``out`` is replaced.
    """
    if model is None:
        return docs.withColumn(out, F.lit(0.5))

    def run(texts: pa.Array) -> pa.Array:
        parts = [score_some(values, model) for _, _, values in sliced_texts(texts)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return docs.withColumn(out, F.arrow_udf(run, "double")(F.col(text)))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return with_quality(docs, model).select(
        "doc_id",
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
