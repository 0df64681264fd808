"""Packing documents into token sequences along a space-filling curve.

A document's vector of hashed token counts (``BUCKETS`` signed buckets, L2-normed) is projected to ``DIMS``
dimensions; each coordinate becomes ``BITS`` bits, and the point's index on the Hilbert curve is the document's key. Documents
are sorted by (key, doc_id) over ranges, and each range is packed end to end: neighbours on the curve share sequences.
A range's last tokens, fewer than a sequence, go to sequences whose lengths are powers of two, which need no padding.

Only a partition's stream is held in a task, one sequence at a time; the id breaks ties of the key, so that a large
group of copies is cut over ranges like all else.

Defined results: null and empty texts have one token, the end mark; documents of one key keep the order of
their ids; rows that repeat are packed as often as they occur; a very long text is cut over as many sequences as it needs; an
empty table gives no pieces; columns but doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, mix64, texts_of, to_batch, words_of

TOKENIZER = "word_bpe_49k.json"
LENGTH = 2048
END = 1
BUCKETS, DIMS, BITS, SEED = 256, 4, 8, 29
#: Words remembered by a worker; beyond it those are forgotten that the slice at hand does not have.
REMEMBER = 400_000
#: Words that are encoded at once.
TOGETHER = 10_000
#: Bytes of text in a slice: the larger, the fewer words are looked up again.
SLICE = 3 << 20
#: Tokens of a range: what a task packs.
RANGE_TOKENS = 4 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts.

    The tokenizer drops white space and never joins across it, so that a text's ids are those of its words, and a word that
    was seen before is not encoded again; it ignores case, so that texts are lowered first. It also parts letters from what is none: a
    word of letters and the point or comma after it are encoded apart. New words of letters are encoded many at once;
    each ends in the one token that has the word-end mark. Known words are an Arrow array, and their ids lie end to end beside it.
    """

    def __init__(self, path: str, end: int = END):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = self._each([".", ","])
        self.known, self.sizes, self.ids = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _each(self, words: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids end to end; ``TOGETHER`` words at a time, for the tokenizer takes much memory for each."""
        parts = [self._encode_some(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
        return np.concatenate([sizes for sizes, _ in parts]), np.concatenate([ids for _, ids in parts])

    def _encode_some(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters = np.fromiter(map(str.isalpha, words), bool, len(words))
        sizes, parts = np.zeros(len(words), np.int64), [None, None]
        for at, rows in enumerate((np.flatnonzero(letters), np.flatnonzero(~letters))):
            some = [words[r] for r in rows.tolist()]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids if some and not at else [], "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if some and len(stops) != len(some):
                each = self._each(some)
                stops, ids = np.cumsum([len(x) for x in each]), np.array([i for x in each for i in x], "<u4")
            sizes[rows], parts[at] = np.diff(np.concatenate([[0], stops])), (rows, ids)
        ids = np.empty(sizes.sum(), "<u4")
        begins = np.cumsum(sizes) - sizes
        for rows, some in parts:
            ids[spans(begins[rows], sizes[rows])] = some
        return sizes, ids

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of distinct words without white space, and the ids end to end."""
        marks = [np.asarray(pc.ends_with(words, m)) for m in ".,"]
        cut = pc.utf8_slice_codeunits(words, 0, -1)
        apart = np.asarray(pc.utf8_is_alpha(cut)) & (marks[0] | marks[1])
        base = pc.if_else(pa.array(apart), cut, words).dictionary_encode()
        found = pc.index_in(base.dictionary, value_set=self.known)
        missing = np.asarray(found.is_null())
        at = np.asarray(pc.fill_null(found, 0)).astype(np.int64)
        if missing.any():
            fresh = base.dictionary.filter(pa.array(missing))
            if len(self.known) + len(fresh) > REMEMBER:  # what these words do not need is forgotten
                own = np.unique(at[~missing])
                begins = np.cumsum(self.sizes) - self.sizes
                self.known, self.ids = self.known.take(pa.array(own)), self.ids[spans(begins[own], self.sizes[own])]
                self.sizes, at = self.sizes[own], np.searchsorted(own, at)
            at[missing] = len(self.known) + np.arange(len(fresh))
            sizes, ids = self._encode(fresh.to_pylist())
            self.known, self.sizes, self.ids = pa.concat_arrays([self.known, fresh]), np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        begins = np.cumsum(self.sizes) - self.sizes
        at = at[np.asarray(base.indices)]
        extra = np.where(apart, np.where(marks[0], len(self.marks[0]), len(self.marks[1])), 0)
        sizes = self.sizes[at] + extra
        out, place = np.empty(sizes.sum(), "<u4"), np.cumsum(sizes) - sizes
        out[spans(place, sizes - extra)] = self.ids[spans(begins[at], self.sizes[at])]
        for mark, ids in zip(marks, self.marks):
            rows = apart & mark
            for k, one in enumerate(ids):
                out[place[rows] + self.sizes[at[rows]] + k] = one
        return sizes, out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end mark, end to end; and where each text's begin."""
        flat, offsets = words_of(pc.ascii_lower(texts))
        coded = flat.dictionary_encode()
        sizes, table = self.words(coded.dictionary)
        words = np.asarray(coded.indices)
        n = sizes[words]
        upto = np.concatenate([[0], np.cumsum(n)])
        per_text = np.diff(upto[offsets])
        starts = np.concatenate([[0], np.cumsum(per_text + 1)])
        out = np.full(starts[-1], self.end, dtype="<u4")
        inside = np.ones(len(out), dtype=bool)
        inside[starts[1:] - 1] = False
        out[inside] = table[spans((np.cumsum(sizes) - sizes)[words], n)]
        return out, starts


def spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of spans, end to end."""
    upto = np.cumsum(sizes)
    return np.repeat(begins - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)


@lru_cache(maxsize=2)
def encoder(path: str, end: int = END) -> Encoder:
    return Encoder(path, end)


@lru_cache(maxsize=4)
def projection(buckets: int = BUCKETS, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, dims))


def curve_points(ids: np.ndarray, starts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Integer coordinates of each document from its hashed token counts."""
    mixed = mix64(ids.astype(np.uint64) + np.uint64(SEED))
    sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
    n = len(starts) - 1
    where = np.repeat(np.arange(n), np.diff(starts)) * BUCKETS + (mixed % np.uint64(BUCKETS)).astype(np.int64)
    counts = np.bincount(where, weights=sign, minlength=n * BUCKETS).reshape(n, BUCKETS)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    flat = (counts / np.maximum(norm, 1e-12)) @ projection()
    # coordinates are about normal: their distribution function spreads them evenly over the cells
    even = 1 / (1 + np.exp(-1.702 * flat))
    return np.minimum((even * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index of integer points on the Hilbert curve: rotations and reflections undone from the top bit down, then a Gray code."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            upper = (x[d] >> level & 1).astype(bool)
            x[0] = np.where(upper, x[0] ^ low, x[0])
            swap = np.where(upper, 0, (x[0] ^ x[d]) & low)
            x[0] ^= swap
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] >> level & 1, turn ^ ((1 << level) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | x[d] >> level & 1
    return key


TOKENS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """doc_id, key on the curve, doc_tokens, ids (2 bytes a token where the vocabulary allows it, else 4)."""

    def work(batches):
        encode = encoder(path, end).encode
        for part in chunks(batches, max_bytes=SLICE):
            ids, starts = encode(texts_of(part.column(1)))
            keys = hilbert_key(curve_points(ids, starts))
            raw, size = (ids.astype("<u2").tobytes(), 2) if not len(ids) or ids.max() < 1 << 16 else (ids.tobytes(), 4)
            rows = [raw[a:b] for a, b in zip((size * starts[:-1]).tolist(), (size * starts[1:]).tolist())]
            yield to_batch(TOKENS, part.column(0), keys, np.diff(starts), rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, key long, doc_tokens long, ids binary")


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = True, **columns) -> DataFrame:
    """The pieces of all sequences. ``with_ids=False`` leaves the ids out of the result (null)."""
    tokens = materialize(tokenize(docs, path or tokenizer_path(), **columns), "pack-tokens")
    total = tokens.agg(F.sum("doc_tokens")).first()[0] or 0
    ranges = max(1, -(-total // RANGE_TOKENS))
    spread = tokens.repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions("key", "doc_id")

    def work(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # the tail that does not fill a sequence yet: id, start, ids, tokens of the document
        used = 0

        def cut(size: int):
            nonlocal held, used, sequence
            taken, offset, rest = [], 0, []
            for doc, start, ids, n in held:
                some = min(len(ids), size - offset)
                if some:
                    raw = ids[:some].tobytes()
                    taken.append((doc, start, some, raw if with_ids else None, zlib.crc32(raw), n, sequence, offset))
                    offset += some
                if some < len(ids):
                    rest.append((doc, start + some, ids[some:], n))
            held, used, sequence = rest, used - size, sequence + 1
            return taken

        def batch(rows):
            return to_batch(PIECES, *map(list, zip(*rows)))

        out = []
        for part in batches:
            for doc, n, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                while used + len(ids) - start >= length:
                    some = length - used
                    held.append((doc, start, ids[start : start + some], n))
                    used, start = length, start + some
                    out += cut(length)
                if start < len(ids):
                    held.append((doc, start, ids[start:], n))
                    used += len(ids) - start
                if len(out) >= 2000:
                    yield batch(out)
                    out = []
        while used:
            out += cut(1 << (used.bit_length() - 1))
        if out:
            yield batch(out)

    return spread.select("doc_id", "doc_tokens", "ids").mapInArrow(work, PIECES_DDL)


def pack_digests(docs: DataFrame) -> DataFrame:
    return pack(docs, with_ids=False).drop("ids")
