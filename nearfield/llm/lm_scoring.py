"""Scoring documents by cross-entropy difference between two matched word bigram models.

The background model counts all documents, the target model all trusted labelled ones. Both have every word and every bigram of
the corpus and one smoothing: absolute discounting, whose left-over mass goes to the unigram. Words are 64-bit hashes.

A token's two losses follow from its bigram alone, in fixed point, so that sums do not depend on their order:

1. Words are counted, as words and as contexts: one table. At most ``WORDS`` frequent ones are broadcast (the head), the rest is joined.
2. Bigrams of the most frequent words of the head alone, at most ``BIGRAMS``, are counted as a matrix, in the pass of the first round, and never shuffled by document.
3. All other tokens are dealt to shards, packed as arrays (a row holds a slice's bigrams of one shard, how often each comes, and
   the documents it comes from): by context, so that a shard has all followers of a context; those of contexts in the head by
   bigram, so that no frequent context lies in one shard. A shard asks the table of words for the counts of its rare words, prices
   its bigrams and sends each slice the sums of its documents. This is done for the contexts in ``ROUNDS`` parts, one after
   the other, so that the disk holds one part at a time; the texts are read once for each.

The heads are shortcuts that also keep frequent keys out of shuffles; results do not depend on their sizes. A bigram outside of the
matrix comes at most as often as the least frequent word that the matrix has.

A document's score is the mean over its tokens of target loss less background loss; lower is nearer to the target.

Defined results: null and empty texts have 0 tokens and null scores; without trusted documents the target is uniform over
the vocabulary; rows that repeat count as often in the background and score alike, and documents of equal words tie; a very long
text is more bigrams; an empty table gives an empty result; columns but doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, materialize, mix64, owners, release, texts_of, to_batch

#: Sizes of the broadcast heads; results do not depend on them.
WORDS, BIGRAMS = 1 << 15, 1 << 20
DISCOUNT, ADD = 0.75, 0.5
#: Context of a document's first word.
START = 0
#: Losses are whole multiples of 1 / UNIT nats; the greatest one, of probability LEAST, fits 31 bits.
UNIT, LEAST = 1 << 26, 1e-12
#: Parts of the contexts. All of them are worked on; more of them take less disk at once.
ROUNDS = 3
#: Tokens that a task holds before it counts or packs them, and tokens of a shard.
HELD, SHARD = 1 << 20, 1 << 19

def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id").distinct()
    return materialize(good, "lm-trusted")


def cut_for(counts: DataFrame, most: int) -> int:
    """The smallest count such that at most ``most`` rows reach it; from a histogram, whose rows are few (counts of counts)."""
    bins = counts.groupBy(F.when(F.col("n") < 1000, F.col("n")).otherwise(F.ceil(F.pow(F.lit(2.0), F.floor(F.log2("n") * 16) / 16))).alias("at")).agg(F.count("*").alias("rows"))
    total, cut = 0, None
    for row in sorted(bins.collect(), key=lambda r: -r["at"]):
        total += row["rows"]
        if total > most:
            break
        cut = row["at"]
    return int(cut) if cut is not None else 1 << 62


_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Of eight bytes, read from the lowest, the first k.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`.common.hashed_words`, with other hashes: a word is read as its pieces of eight bytes, and most words are one."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or ends[-1] == ends[0]:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    n = int(ends[-1] - ends[0])
    data = np.zeros(n + 8, dtype=np.uint8)
    data[:n] = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = (data[:n] != 32) & (data[:n] - np.uint8(9) > 4)  # wraps
    change = np.empty(n + 1, dtype=bool)
    change[0], change[n] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=change[1:n])
    inner = ends[(ends > 0) & (ends < n)]
    split = np.unique(inner[inside[inner - 1] & inside[inner]])  # one text ends with a word and the next begins with one
    at = np.flatnonzero(change)
    if len(split):
        at = np.insert(at, np.searchsorted(at, split.repeat(2)), split.repeat(2))
    first, size = at[::2], at[1::2] - at[::2]
    eight = np.ndarray((n + 1,), dtype="<u8", buffer=data, strides=(1,))
    held = eight[first] & _FIRST[np.minimum(size, 8)]
    long = np.flatnonzero(size > 8)
    if len(long):
        parts = (size[long] + 7) >> 3
        begin = np.cumsum(parts) - parts
        number = np.arange(int(parts.sum())) - np.repeat(begin, parts)
        left = np.repeat(size[long], parts) - 8 * number
        pieces = eight[np.repeat(first[long], parts) + 8 * number] & _FIRST[np.minimum(left, 8)]
        held[long] = np.add.reduceat(mix64(pieces + (number + 1).astype(np.uint64) * _STEP), begin)
    return mix64(held + size.astype(np.uint64) * _ODD), np.searchsorted(first, ends)


def bigrams_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token's previous word and of its own, and where each document's begin."""
    ids, offsets = word_hashes(texts_of(column))
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[offsets[:-1][np.diff(offsets) > 0]] = START
    return before, ids, offsets


def pair_keys(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One 64-bit key of each bigram."""
    return (before << np.uint64(1) | before >> np.uint64(63)) ^ ids


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """text, doc_id, and 1 for documents of the target, else 0. The ids grow with the labels: Spark chooses the join by their size."""
    hit = ids.select(F.col("doc_id").alias("_hit"))
    found = docs.select("doc_id", "text").join(hit, F.col("doc_id") == F.col("_hit"), "left")
    return found.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("_hit").isNull(), 0).otherwise(1).cast("int").alias("is_target"))


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def find(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``sought`` in the sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(sought), dtype=np.int64), np.zeros(len(sought), dtype=bool)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return at, keys[at] == sought


def numbered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows``, sorted, and which of them each is."""
    if int(rows.max()) > 4 * len(rows):
        return np.unique(rows, return_inverse=True)
    seen = np.zeros(int(rows.max()) + 1, dtype=bool)
    seen[rows] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[rows]


def target_of(part, offsets: np.ndarray) -> np.ndarray:
    """1 for each token of a trusted document."""
    return np.repeat(np.asarray(part.column(2), dtype=np.int64), np.diff(offsets))


COUNTS = pa.schema([(c, pa.int64()) for c in ("word", "u", "u_target", "c", "c_target")])


def word_counts(texts: DataFrame) -> DataFrame:
    """word, u, u_target, c, c_target: how often each word comes, and how often something follows it, in all documents and in the target's."""

    def summed(keys, weights):
        keys, weights = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
        first = starts(keys)
        n = np.diff(np.concatenate([first, [len(keys)]]))
        return keys[first].view(np.int64), n, np.add.reduceat(weights, first)

    def rows(held):
        ids, weights, lasts, ends = held
        n, n_target = sum(map(len, ends)), sum(int(e.sum()) for e in ends)
        yield to_batch(COUNTS, [START], [0], [0], [n], [n_target])
        word, u, u_target = summed(ids, weights)
        yield to_batch(COUNTS, word, u, u_target, u, u_target)
        word, c, c_target = summed(lasts, ends)  # nothing follows a document's last word
        none = np.zeros(len(word), dtype=np.int64)
        yield to_batch(COUNTS, word, none, none, -c, -c_target)

    def work(batches):
        held, n = [[], [], [], []], 0
        for part in chunks(batches, column=0):
            ids, offsets = word_hashes(texts_of(part.column(0)))
            if not len(ids):
                continue
            weights, last = target_of(part, offsets), offsets[1:][np.diff(offsets) > 0] - 1
            for into, some in zip(held, (ids, weights, ids[last], weights[last])):
                into.append(some)
            n += len(ids)
            if n >= HELD:
                yield from rows(held)
                held, n = [[], [], [], []], 0
        if n:
            yield from rows(held)

    counted = texts.mapInArrow(work, "word long, u long, u_target long, c long, c_target long")
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("u", "u_target", "c", "c_target")])


class Head:
    """Frequent words with their counts, sorted; ``rank`` numbers those that the matrix of bigrams has, and is -1 for the others."""

    def __init__(self, rows: pa.Table, side: int):
        word = np.asarray(rows.column("word").combine_chunks()).view(np.uint64)
        order = np.argsort(word)
        self.words = word[order]
        self.u, self.u_target, self.c, self.c_target = (np.asarray(rows.column(c).combine_chunks())[order] for c in ("u", "u_target", "c", "c_target"))
        top = np.lexsort((self.words, -np.maximum(self.u, self.c)))[:side]
        self.side, self.kind = len(top), np.uint16 if len(word) <= 1 << 16 else np.uint32
        self.rank = np.full(len(word), -1, dtype=np.int64)
        self.rank[top] = np.arange(len(top))
        self.top = top
        self.begins = np.searchsorted(self.words >> np.uint64(43), np.arange((1 << 21) + 1, dtype=np.uint64)).astype(np.int32)

    def places(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :func:`find`, from where words of the same first 21 bits begin, of which there are few."""
        if not len(self.words):
            return find(self.words, sought)
        at, last = self.begins[sought >> np.uint64(43)], np.int32(len(self.words) - 1)
        np.minimum(at, last, out=at)
        found = self.words[at]
        hit, behind = found == sought, np.flatnonzero(found < sought)
        while len(behind):
            behind = behind[at[behind] < last]
            at[behind] += 1
            found = self.words[at[behind]]
            hit[behind] = found == sought[behind]
            behind = behind[found < sought[behind]]
        return at, hit

    def ranks(self, before: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the place of its bigram in the matrix, or -1; and whether its context is in the head."""
        at, hit = self.places(ids)
        own = np.where(hit, self.rank[at], -1) if len(self.words) else np.full(len(ids), -1)
        begin = find(self.words, np.array([START], dtype=np.uint64))
        ahead, hot = np.empty_like(own), np.empty_like(hit)
        ahead[1:], hot[1:] = own[:-1], hit[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        hot[first] = begin[1][0]
        ahead[first] = self.rank[begin[0][0]] if begin[1][0] else -1
        return np.where((own >= 0) & (ahead >= 0), ahead * self.side + own, -1), hot


CELLS = pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("n_target", pa.int64())])


def matrix(dealt: DataFrame, held) -> np.ndarray:
    """Counts of the bigrams of frequent words: all, and those of the target. side * side of them, at most ``BIGRAMS``."""

    def work(batches):
        for batch in batches:
            for columns in zip(*[batch.column(c) for c in ("far", "times", "docs")]):
                some = [np.frombuffer(c.as_buffer(), np.int64) for c in columns]
                for a in range(0, len(some[0]), 100_000):
                    yield to_batch(CELLS, *[c[a : a + 100_000] for c in some])

    counted = dealt.where(F.col("shard") == MATRIX).mapInArrow(work, "cell long, n long, n_target long")
    found = counted.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).toArrow()
    out = np.zeros((2, held.value.side**2), dtype=np.int64)
    at = np.asarray(found.column("cell").combine_chunks())
    for k, c in enumerate(("n", "n_target")):
        out[k][at] = np.asarray(found.column(c).combine_chunks())
    return out.reshape(2, held.value.side, held.value.side)


def loss(n, c, d, u, total: int, size: int) -> np.ndarray:
    """Loss of bigrams in units of 1 / UNIT nats: of their counts, their contexts' counts and numbers of followers, and their words' counts."""
    back = np.where(c > 0, DISCOUNT * d / np.maximum(c, 1), 1.0)
    p = np.maximum(n - DISCOUNT, 0) / np.maximum(c, 1) + back * (u + ADD) / (total + ADD * size)
    return np.rint(-np.log(np.maximum(p, LEAST)) * UNIT).astype(np.int64)


def row_keys(doc_ids, keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row's key, of its id and its text: ids may repeat with other texts."""
    places = np.arange(len(keys)) - np.repeat(offsets[:-1], np.diff(offsets))
    run = np.zeros(len(keys) + 1, dtype=np.uint64)
    np.cumsum(keys * (2 * places + 1).astype(np.uint64), out=run[1:])  # keys are mixed; odd factors tell their order
    return mix64(mix64(np.asarray(doc_ids, dtype=np.int64).view(np.uint64)) + run[offsets[1:]] - run[offsets[:-1]]).view(np.int64)


#: Instead of a shard's number: rows with the keys of a chunk's rows, and with the cells of the matrix that a task has counted.
KEYS, MATRIX = -1, -2
DEALT = "shard int, chunk long, kinds binary, near binary, far binary, times binary, docs binary"
PACKED = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ("kinds", "near", "far", "times", "docs")]])
ASKED = pa.schema([("shard", pa.int32()), ("word", pa.int64()), ("d", pa.int64()), ("d_target", pa.int64())])
SUMS = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("rest", pa.binary()), ("background", pa.binary()), ("target", pa.binary())])
FOUND = pa.schema([("row", pa.int64()), ("rest", pa.int64()), ("rest_background", pa.int64()), ("rest_target", pa.int64())])


def deal(texts: DataFrame, held, turn: int, shards: int) -> DataFrame:
    """Tokens of a round's contexts beyond the matrix, packed by slice (chunk) and shard, and the keys of a chunk's rows.

    The first round counts the matrix as well: cells, how often each comes, and how often in the target.
    A row's bigrams come in four kinds, and kinds says how many of each: 1 if the context is in the head, and 2 if the word is. Of their
    contexts and words, in turn, near has the places of those in the head, far the others.
    docs: twice the row's place in the chunk for each token, and one more for rows of the target; in 16 bits where these do.
    """

    def packed(head, chunk, before, ids, hot, docs, rows):
        before, ids, hot, docs, rows = (np.concatenate(x) for x in (before, ids, hot, docs, rows))
        keys = pair_keys(before, ids)
        order = np.argsort(keys, kind="stable")
        before, ids, docs, keys = before[order], ids[order], docs[order], keys[order]
        first = starts(before, ids)
        times = np.diff(np.concatenate([first, [len(keys)]]))
        shard = (np.where(hot[order[first]], keys[first], before[first]) >> np.uint64(32)) % np.uint64(shards)  # bits of mixed hashes
        place, near = head.places(np.stack([before[first], ids[first]], axis=1).ravel())
        kind = near[::2] + np.uint8(2) * near[1::2]
        by = np.argsort(shard * np.uint64(4) + kind, kind="stable")
        shard, first, times, kind = shard[by], first[by], times[by], kind[by]
        place, near = place.reshape(-1, 2)[by].ravel(), near.reshape(-1, 2)[by].ravel()
        ends = np.cumsum(times)
        docs = docs[np.repeat(first - ends + times, times) + np.arange(len(docs))].astype(np.uint16 if 2 * len(rows) <= 1 << 16 else np.uint32)
        far, times = np.stack([before[first], ids[first]], axis=1).ravel()[~near], times.astype(np.uint32)
        at = starts(shard)
        cuts = np.concatenate([at, [len(shard)]])
        kinds = np.bincount(np.repeat(np.arange(len(at)) * 4, np.diff(cuts)) + kind, minlength=4 * len(at)).astype(np.uint32).reshape(-1, 4)
        run, nears = np.concatenate([[0], ends]), np.concatenate([[0], np.cumsum(near)])[2 * cuts]
        place, fars = place[near].astype(head.kind), 2 * cuts - nears
        out = [[KEYS, *shard[at].tolist()], [chunk] * (len(at) + 1), [b""], [b""], [rows.tobytes()], [b""], [b""]]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            out[2].append(kinds[k].tobytes())
            out[3].append(place[nears[k] : nears[k + 1]].tobytes())
            out[4].append(far[fars[k] : fars[k + 1]].tobytes())
            out[5].append(times[a:b].tobytes())
            out[6].append(docs[run[a] : run[b]].tobytes())
        return to_batch(PACKED, *out)

    def work(batches):
        head, chunk = held.value, TaskContext.get().partitionId() << 32
        waiting, n, rows = [[], [], [], [], []], 0, 0
        cells = np.zeros((2, head.side**2), dtype=np.int64) if turn == 0 else None
        for part in chunks(batches, column=0):
            before, ids, offsets = bigrams_of(part.column(0))
            cell, hot = head.ranks(before, ids, offsets)
            if turn == 0:
                inside = cell >= 0
                cells[0] += np.bincount(cell[inside], minlength=head.side**2)
                cells[1] += np.bincount(cell[inside & (target_of(part, offsets) > 0)], minlength=head.side**2)
            mine = np.flatnonzero((cell < 0) & ((before >> np.uint64(8)) % np.uint64(ROUNDS) == turn))
            if not len(mine):
                continue
            docs = (owners(offsets)[mine] + rows) * 2 + target_of(part, offsets)[mine]
            for into, some in zip(waiting, (before[mine], ids[mine], hot[mine], docs, row_keys(part.column(1), pair_keys(before, ids), offsets))):
                into.append(some)
            n, rows = n + len(mine), rows + part.num_rows
            if n >= HELD:
                yield packed(head, chunk, *waiting)
                chunk, waiting, n, rows = chunk + 1, [[], [], [], [], []], 0, 0
        if n:
            yield packed(head, chunk, *waiting)
        if turn == 0 and cells[0].any():
            some = np.flatnonzero(cells[0])
            yield to_batch(PACKED, [MATRIX], [chunk], [b""], [b""], [some.tobytes()], [cells[0][some].tobytes()], [cells[1][some].tobytes()])

    return texts.mapInArrow(work, DEALT)


class Shard:
    """Bigrams of a shard, from its packed rows: sorted, each once, with their counts; ``of`` says which one each packed bigram is.

    ``before_at`` and ``word_at`` are places in the head, or -1.
    """

    def __init__(self, table: pa.Table, head: Head):
        table = table.combine_chunks()
        self.chunks = np.asarray(table.column("chunk"))

        def arrays(name, kind):
            return [np.frombuffer(b.as_buffer(), kind) for b in table.column(name)]

        self.times = times = arrays("times", np.uint32)
        self.docs = [d.view(np.uint32) if len(d) > t.sum() else d for d, t in zip(arrays("docs", np.uint16), times)]
        kinds, near, far = (np.concatenate(arrays(*x)) for x in (("kinds", np.uint32), ("near", head.kind), ("far", np.uint64)))
        kind = np.repeat(np.tile(np.arange(4), len(times)), kinds)
        known = np.stack([kind & 1, kind >> 1], axis=1).ravel() > 0
        both, at = np.empty(len(known), dtype=np.uint64), np.full(len(known), -1, dtype=np.int32)
        both[known], both[~known], at[known] = head.words[near], far, near
        before, word = both[::2].copy(), both[1::2].copy()
        every = np.concatenate(times).astype(np.int64)
        run = np.concatenate([[0], np.cumsum(np.concatenate(self.docs) & 1, dtype=np.int64)])
        ends = np.cumsum(every)
        order = np.lexsort((word, before))
        first = starts(before[order], word[order])
        self.before, self.word = before[order[first]], word[order[first]]
        self.before_at, self.word_at = (at[k::2][order[first]] for k in (0, 1))
        self.n = np.add.reduceat(every[order], first)
        self.n_target = np.add.reduceat((run[ends] - run[ends - every])[order], first)
        self.of = np.empty(len(order), dtype=np.int64)
        self.of[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(order)]])))
        self.contexts = starts(self.before)
        self.followers = np.diff(np.concatenate([self.contexts, [len(self.before)]]))
        self.followers_target = np.add.reduceat((self.n_target > 0).astype(np.int64), self.contexts)


def asked(dealt: DataFrame, held) -> DataFrame:
    """shard, word of rare words whose counts a shard needs; and, as shard -1, a frequent context's followers in a shard (d, d_target)."""

    def work(key, table):
        shard = Shard(table, held.value)
        rare = np.sort(shard.word[shard.word_at < 0])
        rare = rare[starts(rare)].view(np.int64)
        known = shard.before_at[shard.contexts] >= 0
        hot = shard.before[shard.contexts][known].view(np.int64)
        none = np.zeros(len(rare), dtype=np.int64)
        number = np.concatenate([np.full(len(rare), key[0].as_py()), np.full(len(hot), -1)]).astype(np.int32)
        d = [np.concatenate([none, x[known]]) for x in (shard.followers, shard.followers_target)]
        return pa.Table.from_batches([to_batch(ASKED, number, np.concatenate([rare, hot]), *d)], schema=ASKED)

    return dealt.groupBy("shard").applyInArrow(work, "shard int, word long, d long, d_target long")


def priced(dealt: DataFrame, replies: DataFrame, held, followers, totals: tuple[int, int, int]) -> DataFrame:
    """Of each chunk and shard: its rows, their tokens there and the sums of their losses."""

    def whole_sums(docs, values, size):
        """Sums of whole numbers by row, exact beyond 53 bits."""
        high, low = values >> 20, values & ((1 << 20) - 1)
        return (np.bincount(docs, high, size).astype(np.int64) << 20) + np.bincount(docs, low, size).astype(np.int64)

    def work(key, table, told):
        out = [[] for _ in SUMS]
        if table.num_rows:
            head = held.value
            shard = Shard(table, head)
            told = told.combine_chunks()
            rare = np.asarray(told.column("word"), dtype=np.int64).view(np.uint64)
            order = np.argsort(rare)
            in_head, in_told = (shard.word_at, shard.word_at >= 0), find(rare[order], shard.word)
            at, hot = shard.before_at[shard.contexts], shard.before_at[shard.contexts] >= 0
            of_context = np.repeat(np.arange(len(shard.contexts)), shard.followers)
            losses = []
            for k, (n, own, d, name) in enumerate(((shard.n, shard.followers, followers.value[0], ""), (shard.n_target, shard.followers_target, followers.value[1], "_target"))):
                c = np.add.reduceat(n, shard.contexts)
                u = n.copy()  # a word that nobody knows comes here alone
                for (place, hit), values in ((in_head, getattr(head, f"u{name}")), (in_told, np.asarray(told.column(f"u{name}"), dtype=np.int64)[order])):
                    u[hit] = values[place[hit]]
                c[hot], own = getattr(head, f"c{name}")[at[hot]], own.copy()
                own[hot] = d[at[hot]]
                losses.append(loss(n, c[of_context], own[of_context], u, totals[k], totals[2]))
            run = 0
            for chunk, docs, times in zip(shard.chunks, shard.docs, shard.times):
                of = np.repeat(shard.of[run : run + len(times)], times)
                run += len(times)
                rows, place = numbered(docs >> 1)
                out[0].append(chunk)
                out[1].append(rows.astype(np.uint32).tobytes())
                out[2].append(np.bincount(place, minlength=len(rows)).astype(np.int64).tobytes())
                for into, values in zip(out[3:], losses):
                    into.append(whole_sums(place, values[of], len(rows)).tobytes())
        return pa.Table.from_batches([to_batch(SUMS, *out)], schema=SUMS)

    both = dealt.groupBy("shard").cogroup(replies.groupBy("shard"))
    return both.applyInArrow(work, "chunk long, docs binary, rest binary, background binary, target binary")


def gathered(keys: DataFrame, sums: DataFrame) -> DataFrame:
    """row, rest, rest_background, rest_target: of each row of a chunk, over all shards."""

    def work(key, rows, sums):
        names = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in rows.column("far").combine_chunks()])
        total = np.zeros((3, len(names)), dtype=np.int64)
        columns = [sums.column(c).combine_chunks() for c in ("docs", "rest", "background", "target")]
        for docs, *values in zip(*columns):
            at = np.frombuffer(docs.as_buffer(), np.uint32)  # each row once
            for into, some in zip(total, values):
                into[at] += np.frombuffer(some.as_buffer(), np.int64)
        some = total[0] > 0
        return pa.Table.from_batches([to_batch(FOUND, names[some], *[t[some] for t in total])], schema=FOUND)

    both = keys.groupBy("chunk").cogroup(sums.groupBy("chunk"))
    return both.applyInArrow(work, "row long, rest long, rest_background long, rest_target long")


class Model:
    """Both models as arrays over words numbered from 2 (0 is a word never seen, 1 the start), for corpora that fit one process."""

    def __init__(self, size: int, before: np.ndarray, ids: np.ndarray, counts):
        codes = before * size + ids
        order = np.argsort(codes)
        self.size, self.pairs = size, codes[order]
        self.unigrams, self.back, self.direct = [], [], []
        for n in counts:
            words = np.bincount(ids, weights=n, minlength=size)
            self.unigrams.append((words + ADD) / (words.sum() + ADD * size))
            share = np.maximum(n - DISCOUNT, 0) / np.maximum(np.bincount(before, weights=n, minlength=size), 1)[before]
            self.direct.append(share[order])
            self.back.append(1 - np.bincount(before, weights=share, minlength=size))

    def losses(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Background and target loss of each token."""
        codes = before * self.size + ids
        at = np.minimum(np.searchsorted(self.pairs, codes), max(len(self.pairs) - 1, 0))
        hit = self.pairs[at] == codes if len(self.pairs) else np.zeros(len(codes), dtype=bool)
        out = []
        for k in (0, 1):
            p = self.back[k][before] * self.unigrams[k][ids]
            if len(self.pairs):
                p = p + np.where(hit, self.direct[k][at], 0)
            out.append(-np.log(np.maximum(p, LEAST)))
        return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame):
    """(hashes of the words, model) on the driver, counted plainly: what tests hold :func:`score` against. Scoring does not use it."""
    rows = marked(docs, trusted_ids(labels)).toArrow().combine_chunks()
    before, ids, offsets = bigrams_of(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()))
    target = np.repeat(np.asarray(rows.column("is_target"), dtype=np.int64), np.diff(offsets))
    pairs, at = np.unique(np.stack([before.view(np.int64), ids.view(np.int64)]), axis=1, return_inverse=True)
    at = at.ravel()
    counts = [np.bincount(at, weights=w, minlength=pairs.shape[1]) for w in (None, target)]
    words, ids = np.unique(pairs[1], return_inverse=True)
    before = np.where(pairs[0] == START, 1, np.searchsorted(words, pairs[0]) + 2)
    return words, Model(len(words) + 2, before, ids + 2, [c.astype(np.float64) for c in counts])


LOCAL = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_rest", pa.int64()), ("background", pa.int64()), ("target", pa.int64())])


def score(docs: DataFrame, labels: DataFrame, words: int = WORDS, bigrams: int = BIGRAMS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats a token) and their difference."""
    spark = docs.sparkSession
    texts = marked(docs, trusted_ids(labels))
    known = materialize(word_counts(texts), "lm-words").withColumn("n", F.greatest("u", "c"))
    release(spark)
    cut = cut_for(known, words)
    total = known.agg(F.sum((F.col("u") > 0).cast("long")).alias("size"), F.sum("u").alias("u"), F.sum("u_target").alias("u_target")).first()
    totals = (total["u"] or 0, total["u_target"] or 0, (total["size"] or 0) + 2)  # a word never seen and the start, as in Model
    head = Head(known.where(F.col("n") >= cut).toArrow(), math.isqrt(bigrams))  # ``words`` rows at most
    held = spark.sparkContext.broadcast(head)
    followers = np.zeros((2, len(head.words)), dtype=np.int64)
    shards = max(1, math.ceil(totals[0] / ROUNDS / SHARD))
    found = []
    for turn in range(ROUNDS):
        dealt = materialize(deal(texts, held, turn, shards), f"lm-dealt-{turn}")
        if turn == 0:
            cells = matrix(dealt, held)
            followers[:, head.top] = (cells > 0).sum(axis=2)
        packed = dealt.where("shard >= 0")
        wanted = materialize(asked(packed, held), f"lm-asked-{turn}")
        release(spark)
        hot = wanted.where("shard < 0").groupBy("word").agg(F.sum("d").alias("d"), F.sum("d_target").alias("d_target")).toArrow()  # of the head alone
        at, _ = find(head.words, np.asarray(hot.column("word").combine_chunks()).view(np.uint64))
        for k, c in enumerate(("d", "d_target")):
            followers[k][at] += np.asarray(hot.column(c).combine_chunks())
        replies = wanted.where("shard >= 0").join(known.where((F.col("u") > 1) & (F.col("n") < cut)), "word").select("shard", "word", "u", "u_target")
        sums = materialize(priced(packed, replies, held, spark.sparkContext.broadcast(followers.copy()), totals), f"lm-sums-{turn}")
        release(spark)
        found.append(materialize(gathered(dealt.where(F.col("shard") == KEYS).select("chunk", "far"), sums), f"lm-rest-{turn}"))
        discard(dealt, wanted, sums)
    found = union(found).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("rest", "rest_background", "rest_target")])

    rows, columns = np.arange(head.side).repeat(head.side), np.tile(np.arange(head.side), head.side)
    prices = []
    for k, name in enumerate(("", "_target")):
        c, u = getattr(head, f"c{name}")[head.top], getattr(head, f"u{name}")[head.top]
        prices.append(loss(cells[k].ravel(), c[rows], followers[k][head.top][rows], u[columns], totals[k], totals[2]))
    prices = spark.sparkContext.broadcast(prices)

    def local(batches):
        for part in chunks(batches, column=0):
            before, ids, offsets = bigrams_of(part.column(0))
            cell, _ = held.value.ranks(before, ids, offsets)
            inside, sums = cell >= 0, []
            for some in (~inside, *[np.where(inside, p[cell], 0) if len(p) else np.zeros(len(cell)) for p in prices.value]):
                run = np.concatenate([[0], np.cumsum(some, dtype=np.int64)])
                sums.append(run[offsets[1:]] - run[offsets[:-1]])
            yield to_batch(LOCAL, part.column(1), row_keys(part.column(1), pair_keys(before, ids), offsets), np.diff(offsets), *sums)

    plain = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    rows = plain.mapInArrow(local, "doc_id long, row long, n_tokens long, n_rest long, background long, target long").join(found, "row", "left")

    def mean(name: str):
        # rows that repeat share a key: their sum is that of all, for ``rest`` / ``n_rest`` copies
        far = F.when(F.col("n_rest") > 0, F.col(f"rest_{name}") / (F.col("rest") / F.col("n_rest"))).otherwise(0.0)
        return F.when(F.col("n_tokens") > 0, F.round((F.col(name) + far) / UNIT / F.greatest("n_tokens", F.lit(1)), 6))

    out = rows.select("doc_id", "n_tokens", mean("target").alias("target_loss"), mean("background").alias("background_loss"))
    return out.withColumn("difference", F.round(F.col("target_loss") - F.col("background_loss"), 6))
