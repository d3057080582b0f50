"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes are cut into segments; in each a forward and a backward gated unit read every byte and a
softmax over both states labels every position. A document's probabilities are the mean of its positions'.
The network is trained in numpy by backpropagation through time, on segments of a bounded sample of labelled
documents: at most LABELLED documents of each language, chosen by a hash of their ids, and SEGMENTS segments of each.
Prediction reads whole texts, all segments of a batch in step, so its cost is linear and its memory bounded.

Defined results: a text that is null or has no letter gets `und` and 0; without any labelled document
all texts do; rows that repeat keep a row each; an empty table gives no rows; other columns are carried only
where asked for. Ties between languages go to the one that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bound of the labelled sample: documents of each language, segments of each document.
LABELLED, SEGMENTS = 400, 4
LENGTH, HIDDEN, STEPS, BATCH, RATE = 96, 8, 260, 96, 0.02
LETTER = re.compile(r"[^\W\d_]")
NONE = "und"


@dataclass(frozen=True)
class Network:
    """Per direction: input weights by byte (256, 3H), recurrent weights (H, 3H), bias (3H); output weights (2H, L) and bias."""

    languages: list[str]
    weights: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(w: dict[str, np.ndarray], d: str, codes: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """States (T, B, H) of one direction over codes (T, B) and what backpropagation needs."""
    n, h = w[f"u{d}"].shape[0], np.zeros((codes.shape[1], w[f"u{d}"].shape[0]), dtype=np.float32)
    states, memo = np.empty((*codes.shape, n), dtype=np.float32), []
    for t in range(codes.shape[0]):
        x, y = w[f"x{d}"][codes[t]] + w[f"b{d}"], h @ w[f"u{d}"]
        gates = _sigmoid(x[:, : 2 * n] + y[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(x[:, 2 * n :] + r * y[:, 2 * n :])
        memo.append((codes[t], h, y[:, 2 * n :], z, r, new))
        h = new + z * (h - new)
        states[t] = h
    return states, memo


def _backward(w: dict[str, np.ndarray], d: str, memo: list[tuple], grad: np.ndarray, out: dict[str, np.ndarray]) -> None:
    n, carried = w[f"u{d}"].shape[0], 0.0
    for t in range(len(memo) - 1, -1, -1):
        code, h, y, z, r, new = memo[t]
        g = grad[t] + carried
        dnew = g * (1 - z) * (1 - new * new)
        dz, dr = g * (h - new) * z * (1 - z), dnew * y * r * (1 - r)
        dx = np.concatenate([dz, dr, dnew], axis=1)
        dy = np.concatenate([dz, dr, dnew * r], axis=1)
        np.add.at(out[f"x{d}"], code, dx)
        out[f"b{d}"] += dx.sum(0)
        out[f"u{d}"] += h.T @ dy
        carried = g * z + dy @ w[f"u{d}"].T


def train(samples: list[tuple[str, bytes]], seed: int = 7, hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH) -> Network:
    """samples: (language, segment of at most LENGTH bytes). Adam on the mean cross-entropy over positions."""
    languages = sorted({lang for lang, _ in samples})
    rng = np.random.default_rng(seed)
    if not languages:
        return Network([], {})
    own = {lang: [s for x, s in samples if x == lang] for lang in languages}
    w: dict[str, np.ndarray] = {"o": rng.normal(0, 0.3, (2 * hidden, len(languages))), "c": np.zeros(len(languages))}
    for d in "fb":
        w |= {f"x{d}": rng.normal(0, 0.5, (256, 3 * hidden)), f"u{d}": rng.normal(0, 0.3, (hidden, 3 * hidden)), f"b{d}": np.zeros(3 * hidden)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        label = rng.integers(0, len(languages), batch)  # languages weigh the same
        codes, mask = np.zeros((LENGTH, batch), dtype=np.int64), np.zeros((LENGTH, batch), dtype=np.float32)
        for i, k in enumerate(label):
            s = own[languages[k]][rng.integers(len(own[languages[k]]))]
            codes[: len(s), i], mask[: len(s), i] = np.frombuffer(s, dtype=np.uint8), 1
        fore, memo_f = _forward(w, "f", codes)
        back, memo_b = _forward(w, "b", codes[::-1])
        states = np.concatenate([fore, back[::-1]], axis=2)
        logits = states @ w["o"] + w["c"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(batch), label] -= 1
        p *= (mask / mask.sum())[:, :, None]
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["o"], grads["c"] = np.tensordot(states, p, axes=([0, 1], [0, 1])), p.sum((0, 1))
        ds = p @ w["o"].T
        _backward(w, "f", memo_f, ds[:, :, :hidden], grads)
        _backward(w, "b", memo_b, ds[::-1, :, hidden:], grads)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k in w:
            g = grads[k] * min(1.0, 1.0 / (norm + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            w[k] -= RATE * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return Network(languages, w)


class Labeller:
    """The network laid out for prediction: columns are segments, sigmoids are tanh of halved inputs."""

    def __init__(self, net: Network, columns: int = 2048) -> None:
        self.net, self.columns, w = net, columns, net.weights
        n = self.n = w["uf"].shape[0]
        half = np.concatenate([np.full(2 * n, 0.5), np.ones(n)]).astype(np.float32)
        self.x = {d: np.ascontiguousarray(((w[f"x{d}"] + w[f"b{d}"]) * half).T) for d in "fb"}
        self.u = {d: np.ascontiguousarray((w[f"u{d}"] * half).T) for d in "fb"}
        self.o, self.c = np.ascontiguousarray(w["o"].T), w["c"][:, None]

    def _states(self, d: str, codes: np.ndarray, out: np.ndarray) -> None:
        n, width = self.n, codes.shape[1]
        h, x, y = np.zeros((n, width), np.float32), np.empty((3 * n, width), np.float32), np.empty((3 * n, width), np.float32)
        new = np.empty((n, width), np.float32)
        for t in range(codes.shape[0]) if d == "f" else range(codes.shape[0] - 1, -1, -1):
            np.take(self.x[d], codes[t], axis=1, out=x, mode="clip")
            np.dot(self.u[d], h, out=y)
            gates, z, r = x[: 2 * n], x[:n], x[n : 2 * n]
            gates += y[: 2 * n]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.multiply(r, y[2 * n :], out=new)
            new += x[2 * n :]
            np.tanh(new, out=new)
            h -= new
            h *= z
            h += new
            out[:, t] = h

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): mean over a text's bytes of the probabilities of each position; empty texts get zeros."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        counts = -(-sizes // LENGTH)
        owner = np.repeat(np.arange(len(texts)), counts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        data = np.frombuffer(b"".join(texts) + bytes(LENGTH), dtype=np.uint8)
        begin = np.repeat(np.cumsum(sizes) - sizes, counts) + at * LENGTH
        length = np.minimum(LENGTH, np.repeat(sizes, counts) - at * LENGTH)
        total = np.zeros((len(texts), len(self.net.languages)))
        order = np.argsort(length, kind="stable")  # so that short last segments share a block
        for k in range(0, len(owner), self.columns):
            own = order[k : k + self.columns]
            steps = np.arange(int(length[own].max()))[:, None]
            codes = data[begin[own][None, :] + steps].astype(np.intp)
            inside = (steps < length[own][None, :]).astype(np.float32)
            states = np.empty((2 * self.n, *codes.shape), dtype=np.float32)
            self._states("f", codes, states[: self.n])
            # the backward unit must not read past a short segment's end: there its state is held at zero by reading from the end
            self._back(codes, length[own], states[self.n :])
            flat = states.reshape(2 * self.n, -1)
            p = np.dot(self.o, flat)
            p += self.c
            p -= p.max(0)
            np.exp(p, out=p)
            p *= (inside.ravel() / p.sum(0))[None, :]
            np.add.at(total, owner[own], p.reshape(len(self.o), *codes.shape).sum(1).T)
        return total / np.maximum(sizes, 1)[:, None]

    def _back(self, codes: np.ndarray, length: np.ndarray, out: np.ndarray) -> None:
        if int(length.min()) == codes.shape[0]:
            self._states("b", codes, out)
            return
        # shift short segments to the end, run backward, and shift the states back
        gap = codes.shape[0] - length
        rows = np.arange(codes.shape[0])[:, None]
        moved = np.take_along_axis(codes, (rows - gap[None, :]) % codes.shape[0], axis=0)
        held = np.empty_like(out)
        self._states("b", moved, held)
        back = (rows + gap[None, :]) % codes.shape[0]
        for k in range(out.shape[0]):
            out[k] = np.take_along_axis(held[k], back, axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        # white space is one byte at most between words, so layout does not weigh
        coded = [" ".join(t.split()).encode("utf-8", "replace") if t and LETTER.search(t) else b"" for t in texts]
        found = self.pooled(coded)
        best = found.argmax(1)
        return [(self.net.languages[b], float(min(1.0, row[b]))) if c else (NONE, 0.0) for c, b, row in zip(coded, best, found, strict=True)]


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_segments(docs: DataFrame, labelled: int = LABELLED, segments: int = SEGMENTS) -> list[tuple[str, bytes]]:
    """Segments of at most `labelled` documents of each language (by hash, so that rows sharing an id or a text are told apart); docs has doc_id, text, lang."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(2**40))
    # half as many again as are wanted on average; of these the first `labelled`
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(2**40 if n <= labelled else int(2**40 * min(1.0, 1.5 * labelled / n))))])
    few = known.withColumn("_place", place).where(F.col("_place") < share[F.col("lang")]).select("lang", "text", "_place")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_place", "text"))
    picked = few.withColumn("_rank", rank).where(F.col("_rank") <= labelled).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if LETTER.search(text):
                    data = " ".join(text.split()).encode("utf-8", "replace")
                    for k in range(min(segments, -(-len(data) // LENGTH))):
                        at = k * max(0, len(data) - LENGTH) // max(1, segments - 1)
                        langs.append(lang)
                        parts.append(data[at : at + LENGTH])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["lang", "part"])

    rows = picked.mapInArrow(cut, "lang string, part binary").toArrow()
    return sorted(zip(rows.column("lang").to_pylist(), rows.column("part").to_pylist(), strict=True))


def learn(docs: DataFrame, labelled: int = LABELLED) -> Network:
    return train(labelled_segments(docs, labelled))


def identify(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, lang_pred and score for each row of docs."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    text_at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(net) if net.languages else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(text_at).to_pylist()
                found = labeller.predict(texts) if labeller else [(NONE, 0.0)] * len(texts)
                columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:text_at], *columns], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, docs["text"].alias("_text")).mapInArrow(run, schema)


def filter_known(docs: DataFrame, net: Network, least: float = 0.3) -> DataFrame:
    """The documents whose language is known with a score of at least `least`, with their own columns; text is read once."""
    names = docs.columns
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(net) if net.languages else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = labeller.predict(part.column(text_at).to_pylist()) if labeller else []
                yield part.filter(pa.array([lang != NONE and score >= least for lang, score in found], pa.bool_())) if found else part.slice(0, 0)

    return docs.mapInArrow(run, docs.schema)
