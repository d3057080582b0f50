"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

A token's probability is P(class | the CONTEXT classes before it) * P(token | class). The OUTPUTS most frequent training tokens
(ties by the token) are classes of their own; all other tokens share classes by a rule on their spelling (last
two bytes). P(class | context) is log-bilinear: the context's vectors, each weighted coordinate-wise by its
place, add up to a prediction whose product with every class vector, plus a bias, is normalised by a soft-max in one matrix
product per batch of distinct contexts. P(token | class) = (c + 1) / (N_class + V_class + 1) from the training counts, where
the 1 is for all unseen spellings of the class. So probabilities of a place add up to one.

The counts and the training cover all training documents: each bucket of documents takes noise-contrastive steps on every
token of its training documents from the same start, and the buckets' parameters are averaged by Spark, weighted by their
tokens; PASSES such rounds, each from the averages of the one before.

Documents are dealt over buckets of about BUCKET_CHARS characters, each one row of token numbers and its own vocabulary. Vocabularies meet
in shards by a hash of the token, which add up the buckets' counts and send each bucket its own back, so no vocabulary of the corpus
is held whole in any process, and Spark moves a few blocks of bytes for a bucket instead of a row for each of its tokens.

Defined results: null text is empty, its only token is the end; rows that repeat count and score each; null ids
are kept (never held out); without training documents every count is 0; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

OUTPUTS, SHAPES, CONTEXT, DIMENSION = 512, 256, 3, 24
BUCKET_CHARS = 8_000_000
PASSES, NOISE, RATE, BATCH = 2, 64, 0.1, 512
END, BETWEEN = b"\n", b" "  # no word holds them
SHARD_BUCKETS = 8  # a shard of the vocabularies is about as large as those of so many buckets


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def shape(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % SHAPES


class Classes:
    """Class of a token: its rank among the frequent ones, or OUTPUTS + a rule on its spelling. The class after the last stands for the start."""

    def __init__(self, frequent: list[bytes]) -> None:
        self.rank = {t: i for i, t in enumerate(frequent)}
        self.n = len(frequent) + SHAPES
        self.start = self.n
        self.frequent = len(frequent)

    def of(self, token: bytes) -> int:
        got = self.rank.get(token)
        return self.frequent + shape(token) if got is None else got

    def codes(self, tokens: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
        return np.array([memo[t] if t in memo else memo.setdefault(t, self.of(t)) for t in tokens], dtype=np.int64)


def contexts_of(codes: np.ndarray, start: int) -> np.ndarray:
    """(tokens, CONTEXT): the classes before each token, nearest first."""
    padded = np.concatenate([np.full(CONTEXT, start, dtype=codes.dtype), codes])
    return np.stack([padded[CONTEXT - 1 - k : CONTEXT - 1 - k + len(codes)] for k in range(CONTEXT)], axis=1)


def contexts_in(codes: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """contexts_of documents that stand end to end."""
    out, heads = np.full((len(codes), CONTEXT), start, dtype=codes.dtype), np.cumsum(sizes) - sizes
    for k in range(CONTEXT):
        out[k + 1 :, k] = codes[: max(0, len(codes) - k - 1)]
        for j in range(k + 1):
            out[heads[sizes > j] + j, k] = start
    return out


def fresh(n: int, logs: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "r": rng.normal(0, 0.1, (n + 1, DIMENSION)), "q": rng.normal(0, 0.1, (n, DIMENSION)),
        "c": np.ones((CONTEXT, DIMENSION)), "b": logs.copy(),
    }


def _sums_into(out: np.ndarray, places: np.ndarray, values: np.ndarray, room: np.ndarray) -> None:
    """out[p] = the sum of the values of place p, 0 where it does not occur. 16-bit places sort by radix; pairs of columns add up as complex numbers."""
    order = np.argsort(places, kind="stable")
    own = places[order]
    heads = np.flatnonzero(own[1:] != own[:-1])
    heads += 1
    heads = np.concatenate([[0], heads])
    ordered = np.take(values, order, axis=0, mode="clip", out=room[: len(order)])
    whole = np.dtype((np.void, out.shape[1] * out.itemsize))  # a row is copied as one item
    out[:] = 0
    out.view(whole)[:, 0][own[heads]] = np.add.reduceat(ordered.view(np.complex64), heads, axis=0).view(whole)[:, 0]


def train_nce(w: dict[str, np.ndarray], codes: np.ndarray, contexts: np.ndarray, noise: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """One pass of noise-contrastive AdaGrad steps in 32-bit floats; noise is the classes' unigram distribution.

    The tokens of a batch share its NOISE samples, so scores and gradients of the noise are matrix products. All vectors are rows of
    one table: of the contexts (and two zeros), then of the classes (and the bias and the noise's logarithm, which a prediction's
    last coordinates 1 and -1 add and take away). So a batch is read by one take, its gradients are summed by one sort, and one step follows.
    """
    real, wide = np.float32, DIMENSION + 2
    rng, n = np.random.default_rng(seed), len(noise)
    flat = np.zeros((2 * n + 1) * wide + CONTEXT * DIMENSION, dtype=real)
    seen, g, spare = np.full_like(flat, 0.1), np.zeros_like(flat), np.empty_like(flat)

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[: -CONTEXT * DIMENSION].reshape(2 * n + 1, wide), x[-CONTEXT * DIMENSION :].reshape(CONTEXT, DIMENSION)

    (rows, c), (g_rows, g_c) = parts(flat), parts(g)
    rows[: n + 1, :DIMENSION], rows[n + 1 :, :DIMENSION], rows[n + 1 :, DIMENSION], c[:] = w["r"], w["q"], w["b"], w["c"]
    rows[n + 1 :, DIMENSION + 1] = np.log(NOISE * noise)
    order = rng.permutation(len(codes))
    codes, contexts = codes[order].astype(np.int16), contexts[order].astype(np.int16)
    cumulative = np.cumsum(noise)
    fakes = np.minimum(np.searchsorted(cumulative, rng.random((-(-len(codes) // BATCH), NOISE)) * cumulative[-1]), n - 1).astype(np.int16)
    codes += np.int16(n + 1)
    fakes += np.int16(n + 1)
    p_all, d_all, pull_all = np.ones((BATCH, wide), dtype=real), np.empty(BATCH * (NOISE + 1), dtype=real), np.empty((BATCH, DIMENSION), dtype=real)
    p_all[:, DIMENSION + 1] = -1
    most = BATCH * (CONTEXT + 1) + NOISE
    read_all, sides_all, room = (np.empty((most, wide), dtype=real) for _ in range(3))
    mixer, diagonal = np.zeros((CONTEXT, wide, DIMENSION), dtype=real), np.arange(DIMENSION)
    mix = mixer.reshape(CONTEXT * wide, DIMENSION)  # adds up a token's context vectors, each weighted by its place
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is the 0 it should be
        for at in range(0, len(codes), BATCH):
            size = len(codes[at : at + BATCH])
            places = np.concatenate([contexts[at : at + size].ravel(), codes[at : at + size], fakes[at // BATCH]])
            mid, end = size * CONTEXT, size * (CONTEXT + 1)
            read, sides = np.take(rows, places, axis=0, mode="clip", out=read_all[: len(places)]), sides_all[: len(places)]
            before, q_true, q_fake, p, pull = read[:mid].reshape(size, -1), read[mid:end], read[end:], p_all[:size], pull_all[:size]
            mixer[:, diagonal, diagonal] = c
            np.matmul(before, mix, out=p[:, :DIMENSION])
            # the chance that a token is noise, for the true ones less 1: the gradients of the scores
            both = d_all[: size * (NOISE + 1)]
            d, d_true = both[: size * NOISE].reshape(size, NOISE), both[size * NOISE :]
            np.matmul(p, q_fake.T, out=d)
            np.einsum("id,id->i", p, q_true, out=d_true)
            np.negative(both, out=both)
            np.exp(both, out=both)
            both += 1
            np.reciprocal(both, out=both)
            d_true -= 1
            both *= real(1 / size**0.5)  # the mean over the batch times its root
            of_true = d_true[:, None]
            np.multiply(p, of_true, out=sides[mid:end])
            np.matmul(d.T, p, out=sides[end:])
            np.matmul(d, q_fake[:, :DIMENSION], out=pull)
            q_true *= of_true
            pull += q_true[:, :DIMENSION]  # the gradient of each prediction
            np.matmul(pull, mix.T, out=sides[:mid].reshape(size, -1))
            g_c[:] = (before.T @ pull).reshape(CONTEXT, wide, DIMENSION)[:, diagonal, diagonal]
            _sums_into(g_rows, places, sides, room)
            g_rows[:, DIMENSION + 1] = 0
            np.multiply(g, g, out=spare)
            seen += spare
            np.sqrt(seen, out=spare)
            np.divide(g, spare, out=g)
            g *= real(RATE)
            flat -= g
    return {"r": rows[: n + 1, :DIMENSION].copy(), "q": rows[n + 1 :, :DIMENSION].copy(), "c": c.copy(), "b": rows[n + 1 :, DIMENSION].copy()}


def log_normalised(w: dict[str, np.ndarray], contexts: np.ndarray, codes: np.ndarray, rows: int = 256) -> np.ndarray:
    """log10 P(class | context) for each place; equal (context) rows are normalised once. Contexts may have fewer places than the model."""
    if not len(codes):
        return np.zeros(0)
    n, places = len(w["b"]), contexts.shape[1]
    order = np.lexsort(tuple(np.ascontiguousarray(contexts[:, k], dtype=np.int16) for k in range(places)))  # 16-bit keys sort by radix
    codes, contexts = codes[order], contexts[order]
    changes = np.r_[False, (contexts[1:] != contexts[:-1]).any(1)]
    group = np.cumsum(changes, dtype=np.int32)
    heads = np.flatnonzero(np.r_[True, changes[1:]])
    own, bounds = contexts[heads], np.r_[heads, len(codes)]
    del contexts, changes
    spots = (group % rows) * np.int32(n) + codes  # of each token's score among those of its chunk
    r, c = w["r"].astype(np.float32), w["c"][:places].astype(np.float32)
    mix = np.concatenate([np.diag(x) for x in c])
    q = np.ascontiguousarray(np.concatenate([w["q"], w["b"][:, None]], axis=1).T.astype(np.float32))  # the last row is the bias
    # no score can overflow if the longest vectors' products cannot
    far = sum(np.sqrt(((r * x) ** 2).sum(1).max()) for x in c) * np.sqrt((q[:-1] ** 2).sum(0).max()) + np.abs(q[-1]).max() > 80
    p_all, z_all, one = np.ones((rows, DIMENSION + 1), dtype=np.float32), np.empty((rows, n), dtype=np.float32), np.ones(n, dtype=np.float32)
    scores, totals = np.empty(len(codes), dtype=np.float32), np.empty(len(own), dtype=np.float32)
    for at in range(0, len(own), rows):
        part = own[at : at + rows]
        p, z = p_all[: len(part)], z_all[: len(part)]
        p[:, :DIMENSION] = np.take(r, part, axis=0, mode="clip").reshape(len(part), -1) @ mix
        np.matmul(p, q, out=z)
        first, last = bounds[at], bounds[min(at + rows, len(own))]
        np.take(z.ravel(), spots[first:last], mode="clip", out=scores[first:last])
        top = z.max(1) if far else None
        if far:
            z -= top[:, None]
        np.exp(z, out=z)
        total = totals[at : at + rows]
        np.matmul(z, one, out=total)
        np.log(total, out=total)
        if far:
            total += top
    out = np.empty(len(codes))
    out[order] = scores.astype(np.float64) - totals[group]
    return out / math.log(10)


def _parts(w: dict[str, np.ndarray]) -> list[float]:
    return np.concatenate([w[k].ravel() for k in ("r", "q", "c", "b")]).tolist()


def _whole(flat: np.ndarray, n: int) -> dict[str, np.ndarray]:
    sizes = {"r": (n + 1, DIMENSION), "q": (n, DIMENSION), "c": (CONTEXT, DIMENSION), "b": (n,)}
    out, at = {}, 0
    for k, shape in sizes.items():
        out[k] = np.asarray(flat[at : at + int(np.prod(shape))], dtype=np.float64).reshape(shape)
        at += int(np.prod(shape))
    return out


def _bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt over buckets by a number of their own, so that rows that repeat spread too; a scan of files numbers them alike when it is read again. And how many buckets."""
    chars = docs.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-chars // BUCKET_CHARS))
    row = F.xxhash64("doc_id", F.monotonically_increasing_id())
    return docs.select(F.pmod(row, F.lit(buckets)).alias("bucket"), "doc_id", held_out(F.col("doc_id")).alias("out"), F.coalesce("text", F.lit("")).alias("text")), buckets


def _indexed(rows: DataFrame, shards: int) -> DataFrame:
    """One row a bucket: its documents' ids, folds and lengths, the numbers of all their tokens end to end, and the bucket's own vocabulary with training counts.

    Texts are split here once; training and scoring read numbers only. The vocabulary is dealt over shards by a hash of the token, in the
    order of its numbers, and each shard's part is one text and one run of counts: Spark holds no row or item for a token.
    """
    schema = T.StructType([
        T.StructField("bucket", T.LongType()), T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)), T.StructField("outs", T.ArrayType(T.BooleanType())),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("ids", T.BinaryType()), T.StructField("tokens", T.ArrayType(T.BinaryType())), T.StructField("ns", T.ArrayType(T.BinaryType())),
    ])

    def run(table: pa.Table) -> pa.Table:
        vocabulary: defaultdict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        number, ids = vocabulary.__getitem__, []
        for text in table.column("text"):
            own = tokens_of(text.as_py())
            ids.append(np.fromiter(map(number, own), dtype=np.int32, count=len(own)))
        sizes, every = np.array([len(x) for x in ids]), np.concatenate(ids)
        del ids
        tokens = list(vocabulary)
        shard = np.fromiter(map(zlib.crc32, tokens), dtype=np.uint32, count=len(tokens)) % shards
        order = np.argsort(shard, kind="stable")
        renumbered = np.empty(len(order), dtype=np.int32)
        renumbered[order] = np.arange(len(order), dtype=np.int32)
        every = renumbered[every]
        ns = np.bincount(every[np.repeat(~np.array(table.column("out").to_pylist(), dtype=bool), sizes)], minlength=len(tokens))
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        spans = list(zip(bounds[:-1], bounds[1:], strict=True))
        doc_ids = table.column("doc_id").combine_chunks()
        return pa.table({
            "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int64()), "doc_ids": pa.ListArray.from_arrays([0, len(sizes)], doc_ids if isinstance(doc_ids, pa.Array) else doc_ids.chunk(0)),
            "outs": pa.ListArray.from_arrays([0, len(sizes)], pa.array(table.column("out").to_pylist(), pa.bool_())), "sizes": pa.array([sizes], pa.list_(pa.int64())), "ids": pa.array([_packed(every)], pa.binary()),
            "tokens": pa.array([[BETWEEN.join([tokens[i] for i in order[a:b]]) for a, b in spans]], pa.list_(pa.binary())),
            "ns": pa.array([[_packed(ns[a:b]) for a, b in spans]], pa.list_(pa.binary())),
        })

    return rows.groupBy("bucket").applyInArrow(run, schema)


def _packed(ids: np.ndarray, kind: str = "<i4") -> bytes:
    """Numbers as planes of bytes: the high ones are nearly all zeros and take no room once they are compressed."""
    return ids.astype(kind).view(np.uint8).reshape(-1, int(kind[-1])).T.tobytes()


def _unpacked(planes: bytes, kind: str = "<i4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(int(kind[-1]), -1).T).view(kind).ravel()


def _counted(indexed: DataFrame) -> DataFrame:
    """The corpus's training counts of each part of a bucket's vocabulary, in its order, as rows (bucket, shard, cs). A shard's first row also has its
    most frequent tokens (top, as many as the model can take), and for each spelling class the counts and the number of its known tokens."""
    parts = indexed.select("bucket", F.posexplode(F.arrays_zip("tokens", "ns")).alias("shard", "t")).select("bucket", "shard", "t.tokens", "t.ns")

    def run(table: pa.Table) -> pa.Table:
        texts = [x.as_py() for x in table.column("tokens")]
        lengths = [x.count(BETWEEN) + 1 if x else 0 for x in texts]
        coded = _marked(texts).dictionary_encode()
        place, distinct = coded.indices.to_numpy(), coded.dictionary
        del coded, texts
        cs = np.zeros(len(distinct), dtype=np.int64)
        at = 0
        for ns, length in zip(table.column("ns"), lengths, strict=True):
            cs[place[at : at + length]] += _unpacked(ns.as_py())  # a token is in a bucket's part once
            at += length
        known = np.flatnonzero(cs)
        least = np.partition(cs[known], -OUTPUTS)[-OUTPUTS] if len(known) > OUTPUTS else 1
        named = lambda which: [x[:-1] for x in distinct.take(pa.array(which)).to_pylist()]
        above = np.flatnonzero(cs > least)
        top = [{"token": t, "c": int(c)} for t, c in [*zip(named(above), cs[above], strict=True), *((t, least) for t in heapq.nsmallest(OUTPUTS, named(np.flatnonzero(cs == least))))]]
        shapes = _shapes(distinct.take(pa.array(known)))
        rows, ends = table.num_rows, np.cumsum(lengths)
        first = lambda x, kind: pa.array([x, *[None] * (rows - 1)], kind)
        return pa.table({
            "bucket": table.column("bucket"), "shard": table.column("shard"), "cs": pa.array([_packed(cs[place[e - n : e]], "<i8") for n, e in zip(lengths, ends, strict=True)], pa.binary()),
            "top": first(top, pa.list_(pa.struct([("token", pa.binary()), ("c", pa.int64())]))),
            "shape_ns": first(np.bincount(shapes, cs[known], SHAPES).astype(np.int64), pa.list_(pa.int64())), "shape_vs": first(np.bincount(shapes, minlength=SHAPES), pa.list_(pa.int64())),
        })

    return parts.groupBy("shard").applyInArrow(run, "bucket bigint, shard int, cs binary, top array<struct<token: binary, c: bigint>>, shape_ns array<bigint>, shape_vs array<bigint>")


def _marked(texts: list[bytes]) -> pa.Array:
    """The tokens of parts of a vocabulary, each with the mark after it."""
    data = np.frombuffer(b"".join(x + BETWEEN for x in texts if x), dtype=np.uint8)
    offsets = np.r_[0, np.flatnonzero(data == BETWEEN[0]) + 1].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _shapes(tokens: pa.Array) -> np.ndarray:
    """The spelling class of tokens that have a mark after them."""
    if not len(tokens):
        return np.zeros(0, dtype=np.int64)
    ends, data = np.frombuffer(tokens.buffers()[1], dtype=np.int32)[tokens.offset : tokens.offset + len(tokens) + 1], np.frombuffer(tokens.buffers()[2], dtype=np.uint8).astype(np.int32)
    return _tails()[data[ends[1:] - 2] + 256 * np.where(np.diff(ends) == 2, 256, data[np.maximum(ends[1:] - 3, 0)])]


@cache
def _tails() -> np.ndarray:
    """The spelling class for each two last bytes (the last one's worth is 1), then for each single one."""
    return np.array([shape(bytes([x // 256, x % 256])) for x in range(65536)] + [shape(bytes([x])) for x in range(256)], dtype=np.int16)


def _coded(texts: list[bytes], classes: Classes) -> np.ndarray:
    """The classes of a bucket's vocabulary, as Classes.of has them."""
    tokens = _marked(texts)
    ranks = pc.index_in(tokens, value_set=pa.array([t + BETWEEN for t in classes.rank], pa.binary())).fill_null(-1).to_numpy()
    return np.where(ranks < 0, classes.frequent + _shapes(tokens), ranks).astype(np.int16)


def _training(row: dict, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Classes and contexts of the training tokens of a bucket's row."""
    sizes, kept = np.array(row["sizes"]), ~np.array(row["outs"], dtype=bool)
    codes = _coded(row["tokens"], classes)[_unpacked(row["ids"])[np.repeat(kept, sizes)]]
    return codes, contexts_in(codes, sizes[kept], classes.start)


def _fit(begun: dict[str, np.ndarray], classes: Classes, noise: np.ndarray, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For the buckets of a partition: the sum of their parameters after a pass from begun, each times the bucket's tokens, and these."""
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                codes, contexts = _training(batch.slice(i, 1).to_pylist()[0], classes)
                if len(codes):
                    flat = np.array(_parts(train_nce(begun, codes, contexts, noise, seed))) * len(codes)
                    total, size = flat if total is None else total + flat, size + len(codes)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), size))], names=["place", "value", "size"])

    return fit


def train(indexed: DataFrame, classes: Classes, noise: np.ndarray) -> dict[str, np.ndarray]:
    """PASSES rounds over all training tokens: each bucket goes on from the last round's averages."""
    weights = fresh(classes.n, np.log(noise))
    for turn in range(PASSES):
        fitted = indexed.select("sizes", "outs", "ids", "tokens").mapInArrow(_fit(weights, classes, noise, 11 + turn), "place bigint, value double, size bigint")
        found = fitted.groupBy("place").agg((F.sum("value") / F.sum("size")).alias("value")).toArrow()  # as many rows as the model has parameters
        if found.num_rows:
            flat = np.empty(found.num_rows)
            flat[found.column("place").to_numpy()] = found.column("value").to_numpy()
            weights = _whole(flat, classes.n)
    return weights


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) for each row of docs(doc_id, text)."""
    rows, buckets = _bucketed(docs)
    indexed = stored(_indexed(rows, -(-buckets // SHARD_BUCKETS)))
    counted = stored(_counted(indexed))
    top = counted.select(F.explode("top").alias("t")).select("t.token", "t.c").orderBy(F.desc("c"), "token").limit(OUTPUTS).collect()
    classes = Classes([bytes(r["token"]) for r in top])
    class_n, class_v = np.zeros(classes.n), np.zeros(classes.n)
    sums = counted.select(F.posexplode(F.arrays_zip("shape_ns", "shape_vs")).alias("shape", "t")).groupBy("shape").agg(F.sum("t.shape_ns").alias("n"), F.sum("t.shape_vs").alias("v"))
    n_all = v_all = 0
    for r in sums.collect():  # one row a spelling class
        class_n[classes.frequent + r["shape"]], class_v[classes.frequent + r["shape"]] = r["n"], r["v"]
        n_all, v_all = n_all + r["n"], v_all + r["v"]
    for i, r in enumerate(top):  # frequent tokens are classes of their own
        of = classes.frequent + shape(bytes(r["token"]))
        class_n[i], class_v[i] = r["c"], 1
        class_n[of] -= r["c"]
        class_v[of] -= 1
    noise = (class_n + 1) / (class_n + 1).sum()
    weights = train(indexed, classes, noise)
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, k) for n, k in (
        ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()),
        ("base_score", T.DoubleType()), ("score", T.DoubleType()))]])
    base = math.log10(n_all + v_all + 1)
    log_room = np.log10(class_n + class_v + 1)

    def score(bucket: pa.Table, counts: pa.Table) -> pa.Table:
        row = bucket.select(["sizes", "ids", "tokens"]).to_pylist()[0]
        code_of = _coded(row["tokens"], classes)
        seen = np.concatenate([_unpacked(x, "<i8") for _, x in sorted(zip(counts.column("shard").to_pylist(), counts.column("cs").to_pylist(), strict=True))]).astype(np.float64)
        logs = np.log10(seen + 1)
        inner = np.where(code_of < classes.frequent, 0.0, logs - log_room[code_of])
        every, sizes = _unpacked(row["ids"]), np.array(row["sizes"])
        del row
        codes, heads = code_of[every], np.cumsum(sizes) - sizes
        model = np.add.reduceat(log_normalised(weights, contexts_in(codes, sizes, classes.start), codes) + inner[every], heads)
        flat = lambda name: bucket.column(name).combine_chunks().flatten()
        return pa.table([
            flat("doc_ids"), flat("outs"), pa.array(sizes, pa.int64()), pa.array(np.add.reduceat((seen > 0)[every].astype(np.int64), heads)),
            pa.array(np.full(len(sizes), n_all, dtype=np.int64)), pa.array(np.add.reduceat(logs[every], heads) - base * sizes), pa.array(model),
        ], names=[f.name for f in schema.fields])

    of_bucket = indexed.select("bucket", "doc_ids", "outs", "sizes", "ids", "tokens").groupBy("bucket")
    return of_bucket.cogroup(counted.select("bucket", "shard", "cs").groupBy("bucket")).applyInArrow(score, schema)
