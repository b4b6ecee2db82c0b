"""Packing by power-of-two decomposition.

Each document's tokens are split into pieces whose lengths are powers of two, the longest first. A piece is a sequence
of its own, so none crosses documents and none is padded; pieces of equal length form a bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, rested, ship

_PUNCT = b".,;:!?*$%&#|"
_SCHEMA = "doc_id long, start long, length long, bucket int, ids_crc32 long, doc_tokens long, input_ids binary"


class WordIds(dict):
    """Ids, as packed unsigned 32-bit numbers, of strings between white space; each is looked up once.

    A tokenizer that splits at white space and at the border between letters and punctuation gives the same ids for
    the parts as for the whole, which leaves few strings to encode. At most 2 * `most` entries are kept: when the
    younger half is full it becomes the older one, so memory stays bounded (some 50 MB) whatever the vocabulary.
    """

    def __init__(self, path: str, most: int = 150_000):
        from tokenizers import Tokenizer

        self.whole, self.most, self.old = Tokenizer.from_file(path), most, {}
        self.model = self.whole.model

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            stem = word.rstrip(_PUNCT)
            if stem.isalpha() and stem.islower():
                ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(stem.decode())])
                if stem != word:
                    ids += self[word[len(stem) :]]
            else:
                try:
                    text = stem.decode()
                except UnicodeDecodeError:
                    text = ""
                if stem != word and text.isalpha():
                    ids = self[stem] + self[word[len(stem) :]]
                else:
                    ids = self.encode(word)
        if len(word) > 64:  # the memory is for words
            return ids
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.whole.encode(text.decode(errors="replace"), add_special_tokens=False).ids])

    def of(self, text: bytes) -> bytes:
        # Strings of special tokens keep their case, as the tokenizer looks for them before it lower-cases.
        parts = (text if b"<|" in text else text.lower()).split()
        return b"".join(map(self.__getitem__, parts))


@cache
def word_ids(path: str) -> WordIds:
    """One for each worker and tokenizer."""
    return WordIds(path)


def lengths(n: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    at = 0
    while n - at >= most:
        yield at, most
        at += most
    left = n - at
    while left:
        size = 1 << (left.bit_length() - 1)
        yield at, size
        at += size
        left -= size


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, bucket (log2 of length), ids_crc32, doc_tokens, input_ids (unsigned
    little-endian 32-bit; null unless with_ids), sequence_id and offset.

    Every piece is one sequence: sequence_id is unique, offset is 0. max_tokens must be a power of two; `tokenizer` is
    a file of a tokenizer that lower-cases and drops white space. Null and empty texts have end_id alone; null doc_ids
    and repeated rows are packed row by row; other columns are ignored. No shuffle: each row is packed where it is
    read, and a piece's sequence_id follows from its place in the input.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    ship(docs.sparkSession)
    tail = end_id.to_bytes(4, "little")

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        for b in chunks(batches):
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                got = (ids.of(text) if text else b"") + tail
                n = len(got) // 4
                for at, size in lengths(n, max_tokens):
                    piece = got[4 * at : 4 * (at + size)]
                    out.append((doc, at, size, size.bit_length() - 1, zlib.crc32(piece), n, piece if with_ids else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "start", "length", "bucket", "ids_crc32", "doc_tokens", "input_ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes pieces with one folder for each length, ready for batches of equal shape."""
    pieces.write.partitionBy("bucket").parquet(path)
