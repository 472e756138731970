"""Operator 3: power-of-two packing.

Each document's tokens are cut into pieces whose lengths are powers of two: as many full pieces as fit, then the binary digits
of the rest, longest first. Pieces of one length form one bucket and every piece is a sequence of its own, so a sequence never
crosses documents and, its length being a power of two, holds no padding. Nothing is shuffled: a document's pieces depend on
the document alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

MOST = 2048
END_ID = 1
CACHED_PIECES = 400_000

#: Characters for which cutting into tokenizer pieces beforehand is known to give the same ids.
_PLAIN = re.compile("[\t\n\r -~À-ÿ]*")
#: The tokenizer's own split pattern, for those characters (fixed value).
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


class Encoder:
    """Token ids of texts as little-endian bytes, with a bounded cache of the ids of frequent pieces.

    Only for tokenizers with this split pattern, lower case and word ends (``word_bpe_49k``); a text with a character outside the
    plain set, or with a special token's string, goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_PIECES.findall(t.lower()) if _PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        fresh = list({p for pieces in cut if pieces is not None for p in pieces} - self.known.keys())
        for at in range(0, len(fresh), 5000):
            some = fresh[at : at + 5000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            bounds = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            if len(bounds) != len(some) + 1:  # a piece was cut otherwise than expected
                self.known.update((p, self.whole(p)) for p in some)
                continue
            raw = ids.tobytes()
            self.known.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(some, bounds[:-1].tolist(), bounds[1:].tolist()))
        get = self.known.__getitem__
        return [self.whole(t) if pieces is None else b"".join(map(get, pieces)) for t, pieces in zip(texts, cut)]


_encoders: dict[str, Encoder] = {}


def binary_pieces(n: int, most: int = MOST) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens: full ones, then the powers of two that sum to the rest."""
    out, at = [], 0
    while n - at >= most:
        out.append((at, most))
        at += most
    bit = most >> 1
    while bit:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


SCHEMA = "doc_id long, start long, length long, tokens binary, doc_tokens long, bucket int, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, most: int = MOST, slice_texts: int = 500) -> DataFrame:
    """Pieces of all ``docs`` (``doc_id``, ``text``), one sequence each; ``most`` must be a power of two.

    ``tokens`` holds the ids as little-endian unsigned 32-bit numbers, ``bucket`` the power of two, ``offset`` is 0. A null or
    empty text is its end id alone: one piece of length 1. Repeated rows are packed as often as they occur; a null ``doc_id``
    stays null; other columns are not read. ``sequence_id`` is unique: the number of the input partition, then a counter.
    """
    if most & (most - 1):
        raise ValueError("most must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core already
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder, number, end = _encoders[tokenizer], TaskContext.get().partitionId() << 33, np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_texts):
                part = batch.slice(at, slice_texts)
                encoded = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                rows = []
                for doc, raw in zip(part.column("doc_id").to_pylist(), encoded):
                    raw += end
                    n = len(raw) // 4
                    for start, length in binary_pieces(n, most):
                        rows.append((doc, start, length, raw[4 * start : 4 * (start + length)], n, length.bit_length() - 1, number, 0))
                        number += 1
                cells = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cells, kinds)], names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)




def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    from pyspark.sql import functions as F

    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences in one folder per length, for batches of equal length or a curriculum over lengths."""
    pieces.write.partitionBy("bucket").parquet(path)
