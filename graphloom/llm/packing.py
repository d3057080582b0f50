"""Best-two-fit packing of tokenised documents into sequences.

Tokenising runs where the documents lie: texts are split at ASCII white space, which the tokenizer never
crosses, and a worker remembers the words it has encoded lately. Documents become pieces of at most `size` tokens.
Pieces are dealt by hash over shards of about `shard_pieces` (the count is known before), and each shard is
packed on its own: a bin is opened with the longest piece left and filled with the longest that fit; then its smallest
piece is replaced by two unpacked pieces that fill the expanded gap more tightly, if there are such. Only the last
bin of a shard is left badly filled, so the loss is a bin per shard at most, at any size of the input.

Defined results: null or empty text is the end token alone; rows that repeat are packed as often as they occur; null ids
are kept; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import functools
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SIZE = 4096
END = 1
SHARD_PIECES = 100_000
#: Words of one generation that a worker remembers; two generations are held, and words in use move to the newer one.
MEMORY_WORDS = 300_000
#: Bytes of texts that are encoded together; a text is not divided.
PART_BYTES = 400_000


#: The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others follow 255 in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class WordEncoder:
    """ids(text) as bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.dot, self.comma = (np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in ".,")

    def _learn(self, words: set[bytes]) -> None:
        """Fills known for words, none of which it holds: from what the generation before knew, or from the tokenizer."""
        if len(self.known) + len(words) > MEMORY_WORDS:
            self.old, self.known = self.known, {}
        known, old, other = self.known, self.old, []
        tokenize, number = self.tokenizer.model.tokenize, struct.Struct("<I").pack
        for w in words:
            if w in old:
                known[w] = old[w]
                continue
            t = w.decode("utf-8", "replace")
            # a word of lower-case letters is one pre-token that the normaliser leaves alone: the model can have it directly
            if t.isalpha() and t.islower() and t == t.lower() and unicodedata.is_normalized("NFC", t):
                known[w] = b"".join([number(x.id) for x in tokenize(t if t.isascii() else w.decode("latin-1").translate(_BYTES))])
            else:
                other.append((w, t))
        for at in range(0, len(other), 1024):
            part = other[at : at + 1024]
            found = self.tokenizer.encode_batch([t for _, t in part], add_special_tokens=False)
            known.update((w, np.array(e.ids, dtype="<u4").tobytes()) for (w, _), e in zip(part, found, strict=True))

    def _ids(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of all these words. What is remembered meanwhile or forgotten makes no difference."""
        # a stop after a letter or digit is a token of its own, so such words are made from the shorter ones and not remembered
        ended = [w for w in words if w[-1] in b".," and w[-2:-1].isalnum()]
        words = words.difference(ended).union([w[:-1] for w in ended])
        out = {w: ids for w in words if (ids := self.known.get(w)) is not None}
        rest = words.difference(out)
        self._learn(rest)
        out.update((w, self.known[w]) for w in rest)
        out.update([(w, out[w[:-1]] + (self.dot if w[-1] == 46 else self.comma)) for w in ended])
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = []
        for t in texts:
            raw = (t or "").encode("utf-8", "replace")
            # the tokenizer lower-cases; only a special token's spelling makes a difference between cases
            split.append((raw if b"<|" in raw else raw.lower()).split())
        ids = self._ids(set().union(*split))
        return [b"".join(map(ids.__getitem__, words)) for words in split]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batch in order, cut wherever another PART_BYTES of the column's texts have gone by."""
    gone = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(gone)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


PIECE = [
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
]


def tokenize(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids array<int>) for each piece of each document."""
    fields = [docs.schema["doc_id"], *PIECE] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stop = _encoder(tokenizer), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for part in _parts(batch, 1):
                owner, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, coded in enumerate(encoder.encode(part.column(1).to_pylist())):
                    coded += stop
                    for k, b in enumerate(range(0, len(coded), 4 * size)):
                        own = coded[b : b + 4 * size]
                        owner.append(i)
                        piece.append(k)
                        start.append(b // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, dtype="<i4"))
                columns = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select("doc_id", docs["text"].alias("_text")).mapInArrow(run, schema)


class _Pool:
    """Unpacked pieces by length; the largest length up to a bound in one step on a bit mask."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.by: dict[int, list[int]] = {}
        for i in np.argsort(lengths, kind="stable").tolist():
            self.by.setdefault(int(lengths[i]), []).append(i)
        self.mask = sum(1 << n for n in self.by)

    def fit(self, room: int) -> int:
        """The largest length there is up to room, or 0."""
        return (self.mask & ((2 << room) - 1)).bit_length() - 1 if room > 0 and self.mask & ((2 << room) - 1) else 0

    def take(self, length: int) -> int:
        own = self.by[length]
        out = own.pop()
        if not own:
            del self.by[length]
            self.mask ^= 1 << length
        return out

    def put(self, length: int, item: int) -> None:
        self.by.setdefault(length, []).append(item)
        self.mask |= 1 << length

    def two(self, room: int, above: int) -> tuple[int, int] | None:
        """Two lengths there are, of the largest sum that is over above and at most room."""
        best, pair, first = above, None, self.fit(room - 1)
        while first and 2 * first > best:
            rest = min(room - first, first)
            second = self.fit(rest)
            if second == first and len(self.by[first]) < 2:
                second = self.fit(first - 1)
            if second and first + second > best:
                best, pair = first + second, (first, second)
                if best == room:
                    break
            first = self.fit(first - 1)
        return pair


def best_two_fit(lengths: np.ndarray, size: int = SIZE) -> list[list[int]]:
    """Bins of indexes; every length is from 1 to size."""
    pool, bins = _Pool(lengths), []
    while pool.mask:
        room, own = size, []
        while n := pool.fit(room):
            own.append((n, pool.take(n)))
            room -= n
        if room and len(own) > 1:
            small, item = own[-1]  # filled from the longest down, so the last is the smallest
            if pair := pool.two(room + small, small):
                own.pop()
                own += [(n, pool.take(n)) for n in pair]
                pool.put(small, item)
                room += small - sum(pair)
                while n := pool.fit(room):
                    own.append((n, pool.take(n)))
                    room -= n
        bins.append([i for _, i in own])
    return bins


def assign_sequences(pieces: DataFrame, size: int = SIZE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """pieces (with a column length) and for each its sequence_id and offset. pieces must give the same rows when read again."""
    shards = max(1, -(-pieces.count() // shard_pieces))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        for b, own in enumerate(best_two_fit(lengths, size)):
            sequence[own] = (key[0].as_py() << 32) + b
            offset[own] = np.concatenate([[0], np.cumsum(lengths[own])[:-1]])
        return table.drop_columns(["_shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # rows that repeat differ by their place in the stored files
    spread = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    return spread.groupBy("_shard").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """A row for each piece, without its ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return assign_sequences(stored(tokenize(docs, tokenizer, size, with_ids=False)), size, shard_pieces)


def packed_sequences(docs: DataFrame, tokenizer: str, size: int = SIZE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The sequences themselves: sequence_id, ids array<int>, doc_ids (of the pieces, in order), lengths."""
    pieces = stored(tokenize(docs, tokenizer, size))
    placed = assign_sequences(pieces.drop("ids"), size, shard_pieces).alias("a")
    full = pieces.dropDuplicates(["doc_id", "piece", "ids_crc32"]).alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.piece") == F.col("b.piece")) & (F.col("a.ids_crc32") == F.col("b.ids_crc32"))
    joined = placed.join(full, same).select("a.sequence_id", F.struct("a.offset", "a.doc_id", "a.length", "b.ids").alias("p"))
    rows = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return rows.select(
        "sequence_id", F.flatten(F.transform("p", lambda p: p["ids"])).alias("ids"),
        F.transform("p", lambda p: p["doc_id"]).alias("doc_ids"), F.transform("p", lambda p: p["length"]).alias("lengths"),
    )
