"""Token counts under a unigram model by dynamic programming over a trie of pre-tokens.

A pre-token is the word mark and a word. Its tokens are the segmentation into vocabulary pieces of the highest summed
log-probability, of the fewest pieces where sums are equal; a character without a piece is spelt in bytes. The
pieces come from a public vocabulary file; since such files give ranks, a piece of rank r has a probability proportional to
1 / (r + SHIFT) (Zipf-Mandelbrot).

The distinct pre-tokens of a slice are visited in the order of a depth-first walk of their trie: the forward scores of a
prefix are computed once for all words below it, and each terminal's count is stored. Documents add up terminals.

Defined results: null and empty texts, and texts of white space, have 0 words and 0 tokens; rows are independent, so that ties,
rows that repeat (which count alike) and extra columns of any name need no care; an empty table gives an empty result; a very long word costs its length times the longest piece.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, texts_of, to_batch, words_of

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
SHIFT = 2.7
#: Log-probability of a byte of a character that has no piece.
BYTE = -25.0


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, float]:
    """Log-probability of each piece, from its rank among the real pieces of the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    real = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + SHIFT) for r in range(1, len(real) + 1)))
    return {p: -math.log(r + SHIFT) - total for r, p in enumerate(real, 1)}


def terminal_counts(words: list[str], scores: dict[str, float]) -> list[int]:
    """Tokens of each of the sorted, distinct pre-tokens."""
    longest = max(map(len, scores))
    best, count = [0.0], [0]  # forward scores along the present branch of the trie
    before, out = "", []
    get = scores.get
    for word in words:
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, n = -math.inf, 0
            for start in range(max(0, end - longest), end):
                score = get(word[start:end])
                if score is not None:
                    score += best[start]
                    if score > top or score == top and count[start] + 1 < n:
                        top, n = score, count[start] + 1
            if word[end - 1] not in scores:
                size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                score = best[end - 1] + BYTE * size
                if score > top or score == top and count[end - 1] + size < n:
                    top, n = score, count[end - 1] + size
            best.append(top)
            count.append(n)
        out.append(count[-1])
        before = word
    return out


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    path = path or vocabulary_path()

    def work(batches):
        scores = pieces(path)
        for part in chunks(batches, max_bytes=8 << 20):
            flat, offsets = words_of(texts_of(part.column(1)))
            coded = flat.dictionary_encode()
            words = [MARK + w for w in coded.dictionary.to_pylist()]
            order = sorted(range(len(words)), key=words.__getitem__)
            table = np.zeros(len(words), dtype=np.int64)
            table[order] = terminal_counts([words[i] for i in order], scores)
            tokens = np.concatenate([[0], np.cumsum(table[np.asarray(coded.indices)])])
            yield to_batch(COUNTS, part.column(0), np.diff(offsets), np.diff(tokens[offsets]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, n_words long, n_tokens long")
