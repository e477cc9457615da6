"""Token ids of texts by a public byte-pair vocabulary.

A text is cut into pieces by the vocabulary's pattern and each piece, as bytes, is merged pair by
pair. A segment tree over the byte positions holds the leftmost pair of least rank; a merge updates
the two pairs beside it, each in logarithmic time, on a list of live neighbours, so that a piece of
n bytes costs n log n however long it is. Pieces repeat, so each worker remembers those it has met.

Defined results: an empty text and a null text have an empty list of ids; text that spells a special
token is ordinary text; every other text gives its bytes back when decoded. A null ``doc_id`` stays.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every operator.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the pattern that cuts a text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

REMEMBERED = 300_000
LONGEST_REMEMBERED = 64


def read_file(path: str) -> bytes:
    """The vocabulary file, read on the driver; it goes to the workers with the job."""
    with open(path, "rb") as file:
        return file.read()


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Bytes -> rank, which is also the id."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}


class Encoder:
    """Encodes texts with one vocabulary, given by its file or the bytes of it."""

    def __init__(self, vocabulary: str | bytes = VOCABULARY, pattern: str = PATTERN):
        self.ranks = read_ranks(vocabulary if isinstance(vocabulary, bytes) else read_file(vocabulary))
        self.cut = regex.compile(pattern).findall
        self.met: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: merge the leftmost pair of least rank until none is left."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        none = len(ranks) * n + n
        tree = [none] * (2 * size)
        for i in range(n - 1):  # a key holds the rank and, to break ties, the position
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        end = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n - 1))  # where the part before starts

        def put(at: int, key: int) -> None:
            i = size + at
            tree[i] = key
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    break
                tree[i] = least
                i >>= 1

        while tree[1] < none:
            i = tree[1] % n
            j = end[i]
            stop = end[i] = end[j]
            if j < n - 1:
                put(j, none)
            r = None
            if stop < n:
                before[stop] = i
                r = ranks.get(piece[i : end[stop]])
            put(i, none if r is None else r * n + i)
            h = before[i]
            if h >= 0:
                r = ranks.get(piece[h:stop])
                put(h, none if r is None else r * n + h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def __call__(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens."""
        out: list[int] = []
        met = self.met
        for piece in self.cut(text) if text else ():
            ids = met.get(piece)
            if ids is None:
                ids = tuple(self.merge(piece.encode()))
                if len(piece) <= LONGEST_REMEMBERED:
                    if len(met) >= REMEMBERED:
                        met.clear()
                    met[piece] = ids
            out.extend(ids)
        return out


def encode(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) for every row of (doc_id, text); nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(read_file(path))  # about a megabyte, whatever the corpus

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            flat, offsets = array("i"), array("i", [0])
            for text in b.column(1):
                flat.extend(encoder(text.as_py()))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(rows, "doc_id BIGINT, ids ARRAY<INT>")


def with_tokens(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens): the size of every document in tokens; the text is not passed on."""
    shared = documents.sparkSession.sparkContext.broadcast(read_file(path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            sizes = [len(encoder(text.as_py())) for text in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(rows, "doc_id BIGINT, source STRING, tokens BIGINT")


def sizes_by_source(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(source, documents, empty, tokens, largest) of the corpus."""
    sized = with_tokens(documents, path)
    return sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("tokens") == 0).alias("empty"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))
