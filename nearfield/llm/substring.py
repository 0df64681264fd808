"""Removing repeated passages by an FM-index for each shard.

A window is ``WIDTH`` consecutive words. Each window has an anchor: the least hash of the word 4-grams inside it; equal
windows have equal anchors. Consecutive windows of one anchor form a segment. Anchors that occur in one document only cannot
hold a repeat; the segments of all others are dealt by anchor to shards, equal segments once with the least document that has
them. Each shard builds an index of its segments (:mod:`fm_index`), and streams the segments through it by
backward search; every window's interval gives the least document in which it starts. Segments join these answers, and
documents lose the words that windows of an earlier document cover.

A frequent anchor is no group of rows in one task: minima are partial, joins are by (anchor, segment), and a shard with more
than ``MOST`` words is indexed in blocks, with all its segments streamed through each.

Words are compared by 64-bit hashes for anchors and by 32 bits of them inside a shard: two windows of one anchor that differ in one
word are taken for equal with probability 2 ** -32.

Defined results: null and empty texts have 0 words and keep none; texts shorter than a window keep all; a window
repeated within one document only is kept; rows with equal ids count as one document's, so that ties between them keep all; a very
long text is many segments; an empty table gives an empty result; columns but doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, hashed_words, materialize, mix64, release, texts_of, to_batch, words_of
from .fm_index import FMIndex

WIDTH, GRAM = 13, 4
#: Windows of a segment at most, and words of a shard and of an index.
LONGEST, SHARD, MOST = 20, 1 << 20, 1 << 22


def anchors(words: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of all texts: (anchor, text, first word counted over all texts, windows)."""
    none = np.zeros(0, dtype=np.int64)
    if len(words) < width:
        return none.astype(np.uint64), none, none, none
    grams = np.zeros(len(words) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - GRAM + 1 + k]
    least = mix64(grams)
    have, want = 1, width - GRAM + 1
    while have < want:
        some = min(have, want - have)
        least = np.minimum(least[:-some], least[some:])
        have += some
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + width <= offsets[owner + 1])
    anchor, text = least[at], owner[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(at)))
    # long runs of one anchor, as in periodic text, are cut
    pieces = -(-size // LONGEST)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(start, pieces) + nth * LONGEST
    size = np.minimum(np.repeat(size, pieces) - nth * LONGEST, LONGEST)
    return anchor[begin], text[begin], at[begin], size


ANCHORS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64())])
SEGMENTS = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("words", pa.binary())])
ANSWERS = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("least", pa.binary())])


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def work(batches):
        for part in chunks(batches):
            words, offsets = hashed_words(texts_of(part.column(1)))
            anchor, text, _, _ = anchors(words, offsets)
            ids = np.asarray(part.column(0))[text]
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (ids[1:] != ids[:-1])
            yield to_batch(ANCHORS, anchor[new].view(np.int64), ids[new])

    return docs.mapInArrow(work, "anchor long, doc_id long")


def _segment_rows(docs_with_anchors: DataFrame) -> DataFrame:
    """Segments of (doc_id, text, wanted anchors)."""

    def work(batches):
        for part in chunks(batches):
            words, offsets = hashed_words(texts_of(part.column(1)))
            anchor, text, at, size = anchors(words, offsets)
            wanted = part.column(2)
            flat = np.asarray(wanted.flatten())
            owner = np.repeat(np.arange(part.num_rows), np.asarray(wanted.value_lengths()))
            # (text, anchor) pairs that are wanted, by a hash of the pair within this slice
            pair = lambda a, t: mix64(a.view(np.uint64) ^ mix64(t.astype(np.uint64) + np.uint64(1)))
            hit = np.flatnonzero(np.isin(pair(anchor, text), pair(flat, owner)))
            anchor, text, at, size = anchor[hit], text[hit], at[hit], size[hit]
            short = (words >> np.uint64(32)).astype("<u4")
            ids, first = np.asarray(part.column(0)), offsets[text]
            payload = [short[a : a + n + WIDTH - 1].tobytes() for a, n in zip(at.tolist(), size.tolist())]
            # a segment's name: a hash of its words in full
            names = np.zeros(len(at), dtype=np.uint64)
            for k in range(LONGEST + WIDTH - 1):
                use = size + WIDTH - 1 > k
                names[use] = mix64(names[use] + np.uint64(k + 1)) + words[at[use] + k]
            for a in range(0, len(at), 50_000):
                b = a + 50_000
                yield to_batch(SEGMENTS, anchor[a:b].view(np.int64), mix64(names[a:b]).view(np.int64), ids[text[a:b]], (at - first)[a:b], payload[a:b])

    return docs_with_anchors.select("doc_id", "text", "wanted").mapInArrow(work, "anchor long, segment long, doc_id long, at long, words binary")


def _search(batches):
    """Builds the index of a shard and streams its segments: for each, the least document of every window."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    words = np.frombuffer(b"".join(table.column(2).to_pylist()), "<u4")
    sizes = np.concatenate([np.asarray(c) for c in pa.compute.binary_length(table.column(2)).chunks]).astype(np.int64) // 4
    values = table.column(3).to_numpy()
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    block = offsets[1:] // MOST
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(sizes)]])
    answer = [None] * (len(cuts) - 1)
    for a, b in zip(cuts[:-1], cuts[1:]):
        index = FMIndex(words[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], values[a:b], WIDTH)
        for k, (c, d) in enumerate(zip(cuts[:-1], cuts[1:])):
            runs, starts = index.runs(words[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c])
            got = np.where(runs >= 0, index.least[runs], np.iinfo(np.int64).max)
            answer[k] = (got if answer[k] is None else np.minimum(answer[k][0], got), starts)
    out = []
    for got, starts in answer:
        out += [got[x:y].astype("<i8").tobytes() for x, y in zip(starts[:-1].tolist(), starts[1:].tolist())]
    for at in range(0, len(out), 50_000):
        some = table.slice(at, 50_000)
        yield to_batch(ANSWERS, some.column(0).combine_chunks(), some.column(1).combine_chunks(), out[at : at + 50_000])


HITS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _hits(batches):
    """(doc_id, at, least of each window) to intervals of covered words."""
    for part in batches:
        if not part.num_rows:
            continue
        sizes = np.asarray(pa.compute.binary_length(part.column(2))).astype(np.int64) // 8
        least = np.frombuffer(b"".join(part.column(2).to_pylist()), "<i8")
        row = np.repeat(np.arange(part.num_rows), sizes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids, at = np.asarray(part.column(0)), np.asarray(part.column(1))
        hit = np.flatnonzero(least < ids[row])
        if not len(hit):
            continue
        row, nth = row[hit], nth[hit]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (nth[1:] != nth[:-1] + 1)
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(row)) - 1
        yield to_batch(HITS, ids[row[start]], at[row[start]] + nth[start], at[row[start]] + nth[end] + WIDTH)


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (words): what windows of an earlier document cover; intervals of one document may overlap."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(_anchor_rows(texts), "anchors")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    shared = materialize(shared, "shared-anchors")
    release(docs.sparkSession)
    wanted = materialize(found.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("wanted")), "wanted")
    discard(found, shared)
    segments = materialize(_segment_rows(texts.join(wanted, "doc_id")), "segments")
    discard(wanted)
    distinct = segments.groupBy("anchor", "segment").agg(F.first("words").alias("words"), F.min("doc_id").alias("value"))
    total = segments.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, -(-total // (4 * SHARD)))
    answers = materialize(distinct.select("anchor", "segment", "words", "value").repartition(shards, "anchor").mapInArrow(_search, "anchor long, segment long, least binary"), "answers")
    rows = segments.select("anchor", "segment", "doc_id", "at").join(answers, ["anchor", "segment"]).select("doc_id", "at", "least")
    hits = materialize(rows.mapInArrow(_hits, "doc_id long, start long, end long"), "hits")
    discard(segments, answers)
    return hits


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words that stay, joined by a space (or their SHA-256)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by_doc = repeated_intervals(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    def work(batches):
        for part in chunks(batches):
            flat, offsets = words_of(texts_of(part.column(1)))
            kept = np.ones(len(flat), dtype=bool)
            gone = part.column(2)
            pairs = gone.flatten()
            row = np.repeat(np.arange(part.num_rows), np.asarray(pa.compute.fill_null(gone.value_lengths(), 0)))
            step = np.zeros(len(flat) + 1, dtype=np.int64)
            np.add.at(step, offsets[row] + np.asarray(pairs.field(0)), 1)
            np.add.at(step, offsets[row] + np.asarray(pairs.field(1)), -1)
            kept = np.cumsum(step[:-1]) == 0
            before = np.concatenate([[0], np.cumsum(kept)])[offsets]
            stays = flat.filter(pa.array(kept)).to_pylist()
            joined = [" ".join(stays[a:b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
            if digest:
                joined = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in joined]
            n = np.diff(offsets)
            yield to_batch(KEPT, part.column(0), n, n - np.diff(before), joined)

    return texts.join(by_doc, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(work, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats_digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


#: The same in DuckDB.
SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sized AS (SELECT doc_id, w, length(w)::BIGINT AS n_words FROM words),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, n_words - 11)) AS i FROM sized WHERE n_words >= 13)),
first AS (SELECT x, min(doc_id) AS least FROM windows GROUP BY x),
hit AS (SELECT DISTINCT doc_id, i + k AS place FROM windows JOIN first USING (x), range(0, 13) AS r(k) WHERE least < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, n_words + 1)) AS place FROM sized),
stays AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.place) AS kept, count(*) AS n
  FROM each e LEFT JOIN hit h ON e.doc_id = h.doc_id AND e.place = h.place WHERE h.place IS NULL GROUP BY e.doc_id)
SELECT s.doc_id, s.n_words, (s.n_words - coalesce(t.n, 0))::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM sized s LEFT JOIN stays t USING (doc_id)
"""
