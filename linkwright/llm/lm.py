"""Stupid-backoff scores of documents under the counts of all other documents.

A block of documents explodes its texts into n-grams and asks the count table for the distinct ones, with how often the block
has each. The table is partitioned by the n-grams' hash: a part adds up the counts of its n-grams over all blocks and answers
each block. Joined back to the block's n-grams, the counts less the document's own give each word the score of the longest
n-gram that another document has too, and the scores are summed by document.

Questions and answers travel as one sorted, packed row for each block and part that has any, since a row for each n-gram would
take more disk than the whole input allows (README). Their rows never outnumber the n-grams; an n-gram that is common is one
entry of each block, so it is no hot key. The number of parts follows the input, that of blocks another size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import blocks_for, table, text_bytes
from .packs import packed, unpacked

ORDER, BACKOFF, UNSEEN = 3, 0.4, 0.5  # a word that no other document has counts as UNSEEN occurrences
_BLOCK, _PART, _TASK = 6 << 20, 10 << 20, 16 << 20  # bytes of text behind a block, a part of the table, a task over blocks
_BITS = 56  # of an n-gram's hash; unequal ones fall together once in 2^56 pairs
_C = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For n from 1 to order the hash of the n-gram that ends at each word (0 where the text is too short for it), and words in each text."""
    known, each = _Words(), []
    for t in texts:  # text by text, so only one text's words are held
        w = t.lower().split()
        each.append(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
    sizes = np.array([len(x) for x in each], np.int64)
    h = np.concatenate(each) if each else np.zeros(0, np.uint64)
    del known, each
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = [_mix(h + _C)]
    for n in range(2, order + 1):
        g = np.zeros(len(h), np.uint64)
        g[1:] = whole[-1][:-1]
        whole.append(np.where(place >= n - 1, _mix(g * _C + h + np.uint64(n)), np.uint64(0)))
    low = np.uint64(1)
    return [np.where(place >= n, np.maximum(g >> np.uint64(64 - _BITS), low), np.uint64(0)) for n, g in enumerate(whole)], sizes


def _every(grams: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([g if n == 0 else g[g != 0] for n, g in enumerate(grams)])


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order and how many of each."""
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(np.append(first, len(h)))


def _cuts(values: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's share of the sorted values begins; parts divide the range of hashes evenly."""
    edges = [(p << _BITS) // parts for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(values, np.array(edges, np.uint64)), [len(values)]]).astype(np.int64)


def _narrow(a: np.ndarray) -> bytes:
    """Little-endian in the fewest bytes that hold the largest, byte planes apart; the first byte tells how many."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([width]) + a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _wide(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


_ASKED = "block bigint, part int, words bigint, grams binary, counts binary"


def _ask(order: int, parts: int):
    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                grams, sizes = _grams(unpacked(row)[1], order)
                values, counts = _distinct(_every(grams))
                del grams
                at, rows = _cuts(values, parts), []
                for p in range(parts):
                    own, n = values[at[p] : at[p + 1]], counts[at[p] : at[p + 1]]
                    if len(own):  # the block's words are told once, with its first share
                        rows.append((row["block"], p, 0 if rows else int(sizes.sum()), _narrow(np.diff(own, prepend=np.uint64(0))), zlib.compress(_narrow(n), 1)))
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["block", "part", "words", "grams", "counts"])

    return ask


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Total counts of each block's share, in the order it asked."""
    asked = [np.cumsum(_wide(g), dtype=np.uint64) for g in pdf["grams"]]
    ends = np.cumsum([len(a) for a in asked])
    _, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    del asked
    own = np.concatenate([_wide(zlib.decompress(c)) for c in pdf["counts"]])
    total = np.bincount(inverse, own).astype(np.int64)[inverse]
    return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "totals": [zlib.compress(_narrow(t), 1) for t in np.split(total, ends[:-1])]})


def word_scores(counts: list[np.ndarray], there: list[np.ndarray], total: int, backoff: float) -> np.ndarray:
    """ln S of each word. counts[n-1] holds how often other documents have the n-gram that ends at the word, there[n-1]
    whether the text has one; total is the number of words of other documents, by word."""
    out = np.log(np.maximum(counts[0], UNSEEN) / np.maximum(total, 1))
    for n in range(2, len(counts) + 1):
        own, context = counts[n - 1], np.concatenate([[1], counts[n - 2][:-1]])
        longer = np.log(np.maximum(own, 1) / np.maximum(context, 1))
        out = np.where(own > 0, longer, np.where(there[n - 1], np.log(backoff) + out, out))
    return out


def _score(order: int, backoff: float):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = unpacked(docs.to_pylist()[0])
        grams, sizes = _grams(texts, order)
        del texts
        there = [np.ones(len(g), bool) if n == 0 else g != 0 for n, g in enumerate(grams)]
        values, inverse = np.unique(_every(grams), return_inverse=True)
        del grams
        answers = answers.sort_by("part")
        totals = [_wide(zlib.decompress(c)) for c in answers["totals"].to_pylist()]
        table_ = np.concatenate(totals).astype(np.int64) if totals else np.zeros(0, np.int64)
        doc, counts, lo = np.repeat(np.arange(len(sizes)), sizes), [], 0
        for r in there:
            k = inverse[lo : lo + int(r.sum())]
            lo += len(k)
            # a document's own occurrences don't speak for it
            _, place, own = np.unique(doc[r] * np.int64(len(values)) + k, return_inverse=True, return_counts=True)
            c = np.zeros(len(r), np.int64)
            c[r] = table_[k] - own[place]
            counts.append(c)
        words = answers["words"][0].as_py() if answers.num_rows else 0
        each = word_scores(counts, there, words - np.repeat(sizes, sizes), backoff) if len(doc) else np.zeros(0)
        sums = np.bincount(doc, each, len(sizes)).astype(float)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": sizes, "log_score": sums, "mean_log": sums / np.maximum(sizes, 1)})

    return score


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """One row per row of docs: doc_id, n_words, log_score (sum of ln S over its words), mean_log (by word).

    Words are runs of anything but ASCII white space, A-Z lower-cased. Counts cover all rows but the scored one itself, so a
    copy of a text counts for it. Null and empty texts have no words and score 0. Null and repeated doc_ids keep their rows
    and count. An empty table gives no rows; other columns are not read.
    """
    size = text_bytes(docs)
    parts = blocks_for(size, _PART)
    blocks = packed(docs, _BLOCK, blocks_for(size, _TASK))
    asked = blocks.mapInArrow(_ask(order, parts), _ASKED).repartition(parts, "part")
    words = asked.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"))  # one row
    answers = asked.groupBy("part").applyInPandas(_answer, "block bigint, part int, totals binary").crossJoin(F.broadcast(words))
    shape = "doc_id bigint, n_words bigint, log_score double, mean_log double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, backoff), shape)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
