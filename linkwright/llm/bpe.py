"""Encoding and decoding through a table of distinct words that is spread over the cluster.

Documents are dealt into blocks by hash. Each block asks for its distinct words: one sorted list for each part of the
word table, compressed, so a word costs a few bytes however often it occurs. A part of the table gathers the lists of all
blocks, encodes each distinct word once, and answers each block in the order of its list. A block joins the ids to the
vocabulary's pieces and puts ids and pieces back by position. Words are split, numbered, looked up and joined as Arrow
columns, a portion of a block at a time. Documents are shuffled once (both uses read one exchange); no task holds more
than a block or a part, whose number follows the size of the input.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import blocks_for, table, text_bytes
from .wordbpe import VOCABULARY, encode_words, in_portions, load

_BLOCK = 26 << 20  # bytes of text in a block
_LEVEL = 6  # of compression
_SEP = "\n"  # never inside a word


def _words(texts: list[str]) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct words; for each portion of the texts, its words as places among these and how many each text has.

    Words end at ASCII white space, where the vocabulary always splits; what else it splits at stays inside.
    """
    found, portions = [pa.array([], pa.large_string())], []
    for _, some in in_portions(texts):
        split = pc.ascii_split_whitespace(pa.array(some, pa.large_string()))
        words, ends = split.flatten(), np.append(0, np.cumsum(split.value_lengths().to_numpy()))
        real = pc.greater(pc.binary_length(words), 0)  # white space around a text leaves empty strings
        coded = words.filter(real).dictionary_encode()
        sizes = np.diff(np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[ends])
        portions.append((coded.indices.to_numpy(), sizes))
        found.append(coded.dictionary)
    together = pa.concat_arrays(found).dictionary_encode()
    place, lo = together.indices.to_numpy(), 0
    for i, (own, (at, sizes)) in enumerate(zip(found[1:], portions)):
        portions[i] = place[lo + at], sizes
        lo += len(own)
    return together.dictionary, portions


def _asked(texts: list[str], parts: int) -> tuple[list[str], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A block's distinct words, sorted within each part of the table; where each part's list ends; and the portions of
    _words with places in this order."""
    found, portions = _words(texts)
    words = found.to_numpy(zero_copy_only=False).tolist()
    part = (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(parts)).astype(np.int64)
    order = pc.array_sort_indices(found).to_numpy()  # neighbours share letters and ids: fewer bytes than in hash order
    order = order[np.argsort(part[order], kind="stable")]
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words), dtype=np.int32)
    return [words[i] for i in order.tolist()], np.cumsum(np.bincount(part, minlength=parts)), [(rank[at], sizes) for at, sizes in portions]


def _pack(a: np.ndarray) -> bytes:
    """Compressed, in the fewest bytes that hold the largest; the first byte tells how many."""
    width = 1 if not len(a) or a.max() < 1 << 8 else 2 if a.max() < 1 << 16 else 4
    return bytes([width]) + zstandard.ZstdCompressor(_LEVEL).compress(a.astype(f"<u{width}").tobytes())


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), f"<u{b[0]}")


def _requests(parts: int):
    def ask(docs: pd.DataFrame) -> pd.DataFrame:
        words, ends, _ = _asked([t or "" for t in docs["text"]], parts)
        lists = [(p, words[lo:hi]) for p, (lo, hi) in enumerate(zip([0, *ends.tolist()], ends.tolist())) if lo < hi]
        z = zstandard.ZstdCompressor(_LEVEL)
        return pd.DataFrame({"block": int(docs["block"].iloc[0]), "part": [p for p, _ in lists], "words": [z.compress(_SEP.join(own).encode()) for _, own in lists]})

    return ask


@cache
def _tokenizer(vocabulary: str):
    """Loaded once for all parts that a Python worker answers."""
    return load(vocabulary)


def _answers(vocabulary: str):
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = list(map(zstandard.ZstdDecompressor().decompress, pdf["words"]))
        sizes = [x.count(_SEP.encode()) + 1 for x in raw]
        asked = pc.split_pattern(pa.array([_SEP.encode().join(raw).decode()], pa.large_string()), _SEP).flatten().dictionary_encode()
        del raw
        flat, counts = encode_words(_tokenizer(vocabulary), asked.dictionary.to_numpy(zero_copy_only=False).tolist())
        starts = np.cumsum(counts) - counts
        rows = []
        for block, k in zip(pdf["block"], np.split(asked.indices.to_numpy(), np.cumsum(sizes)[:-1])):
            n = counts[k]
            ids = flat[np.repeat(starts[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            rows.append((block, pdf["part"].iloc[0], _pack(n), _pack(ids)))
        return pd.DataFrame(rows, columns=["block", "part", "counts", "ids"])

    return answer


@cache
def _tokens(vocabulary: str) -> tuple[pa.Array, pa.Array]:
    """Every id as a number and as its piece."""
    tokenizer = _tokenizer(vocabulary)
    ids = range(tokenizer.get_vocab_size())
    return pa.array(map(str, ids), pa.large_string()), pa.array(map(tokenizer.id_to_token, ids), pa.large_string())


def _spaced(strings: pa.Array, places: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The strings at these places; so many at a time, in turn, joined by a space."""
    ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(ends, strings.take(pa.array(places))), pa.scalar(" ", pa.large_string()))


def _digests(strings: pa.Array) -> list[str]:
    return [hashlib.sha256(x.as_buffer()).hexdigest() for x in strings]


def _joined(vocabulary: str, parts: int, digests: bool):
    def join(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names, texts = docs["doc_id"], [t or "" for t in docs.pop("text")]
        _, _, portions = _asked(texts, parts)
        del docs, texts
        answers = answers.sort_values("part")  # then its lists have the order of the words
        none = [np.zeros(0, np.int64)]
        total, ids = (np.concatenate([*map(_unpack, answers[x])] or none).astype(np.int64) for x in ("counts", "ids"))
        columns = [_spaced(strings, ids, total) for strings in _tokens(vocabulary)]
        n_tokens, both = [], ([], [])
        for at, sizes in portions:  # a block's ids and pieces needn't be held at once
            ends = np.cumsum(sizes)
            n_tokens += np.diff(np.append(0, np.cumsum(total[at]))[np.append(0, ends)]).tolist()
            some = total[at] > 0  # words without ids leave no space behind
            if not some.all():
                at, sizes = at[some], np.diff(np.append(0, np.cumsum(some))[np.append(0, ends)])
            for out, words in zip(both, columns):
                own = _spaced(words, at, sizes)
                out += _digests(own) if digests else own.to_pylist()
        return pd.DataFrame(dict(zip(("doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))), (names, n_tokens, *both))))

    return join


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY, digests: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (decimal, joined by a space), decoded (the decoder's text).

    With digests, ids_sha256 and decoded_sha256 stand for the last two. Null and empty texts have no tokens. Null and
    repeated doc_ids keep their rows. An empty table gives no rows. Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = blocks_for(text_bytes(own), _BLOCK)
    parts = min(blocks, blocks // 4 + 4)  # fewer than blocks: a list stays long enough to compress when there are many
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    asked = dealt.groupBy("block").applyInPandas(_requests(parts), "block int, part int, words binary")
    answers = asked.groupBy("part").applyInPandas(_answers(vocabulary), "block int, part int, counts binary, ids binary")
    shape = "doc_id bigint, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids string, decoded string")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_joined(vocabulary, parts, digests), shape)


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), digests=True)
