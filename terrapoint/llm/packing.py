"""Sum-of-squares online packing of token streams into training windows.

Every document becomes its token ids and one end id. Whole windows are cut off its front; the rest is placed
online into the fill level that keeps the sum of squared counts of partially filled windows smallest. The counts
live in a level array, one entry for each fill level, so a placement costs one pass over the array however many
windows are open. A task packs the documents of its own partition and hands out finished windows as it goes; at its
end it cuts the pieces of the emptiest open windows to fill the others, so that at most one window a task is padded.

Edge cases: a null text counts as empty; an empty text gives one piece that holds only the end id; texts of any
length are cut, never shortened; repeated rows are packed each on its own; an empty table gives no rows; other
columns of the input are ignored, whatever their names. Windows of a power of two tokens need no padding.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapoint.llm.common import trimmed

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_ENCODERS: dict[str, "Encoder"] = {}
#: The word pattern of byte-level BPE. Without runs of white space a look-ahead isn't needed, and the shorter form
#: runs several times faster.
_WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_WORDS_SINGLE_SPACED = r""" ?\p{L}+| ?\p{N}+|'(?:[sdmt]|ll|ve|re)| ?[^\s\p{L}\p{N}]+|\s"""


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a byte-level BPE vocabulary file, as little-endian 32-bit bytes. The file's vocabulary is read
    into a merge engine that gives the same ids several times faster; texts that hold a special token's string, which
    the file's own rules treat apart, go the file's own way."""

    def __init__(self, path: str):
        import json
        import re

        import tiktoken

        self.path, self.tokenizer = path, None  # loaded when a text needs it
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocabulary, special = whole["model"]["vocab"], {t["content"] for t in whole.get("added_tokens", [])}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.spaced, self.single = (tiktoken.Encoding("words", pat_str=p, mergeable_ranks=ranks, special_tokens={})._core_bpe for p in (_WORDS, _WORDS_SINGLE_SPACED))
        self.runs = re.compile(r"\s\s")
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special.search(text):
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.path)
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.spaced if self.runs.search(text) else self.single).encode_ordinary(text)
        return array("I", ids).tobytes() if _LITTLE else np.asarray(ids, dtype="<u4").tobytes()


def encoder(path: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class LevelPacker:
    """The sum-of-squares rule over `window` fill levels. Pieces are (doc_id, start, doc_tokens, bytes of ids)."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """Fill level whose use keeps the sum of squared counts smallest; the fullest of equally good ones."""
        w, n = self.window, self.counts
        change = 2 * (n[size : w + 1] - n[: w + 1 - size]) + 2
        change[0] = 2 * n[size] + 1
        if size < w:
            change[w - size] = 1 - 2 * n[w - size]
        usable = n[: w + 1 - size] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def place(self, piece: tuple, size: int) -> list | None:
        """The window that the piece filled, if it filled one."""
        if size == self.window:
            return [piece]
        level = self.level_for(size)
        held: list = []
        if level:
            self.counts[level] -= 1
            held = self.open[level].pop()
        held.append(piece)
        if level + size == self.window:
            return held
        self.counts[level + size] += 1
        self.open[level + size].append(held)
        return None

    def close(self) -> Iterator[list]:
        """The open windows, the emptiest cut up to fill the others."""
        rest = [(level, w) for level in range(1, self.window) for w in self.open[level]]
        low, high = 0, len(rest) - 1
        spare: list = []
        while low <= high:
            level, held = rest[high]
            high -= 1
            gap = self.window - level
            while gap and (spare or low <= high):
                if not spare:
                    spare = list(reversed(rest[low][1]))
                    low += 1
                doc, start, total, ids = spare.pop()
                take = min(gap, len(ids) // 4)
                held.append((doc, start, total, ids[: 4 * take]))
                if 4 * take < len(ids):
                    spare.append((doc, start + take, total, ids[4 * take :]))
                gap -= take
            yield held
        if spare:
            yield list(reversed(spare))


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, the
    piece's ids (binary, little-endian unsigned 32-bit). Sequence ids are unique over all tasks. Edge cases: see the
    module."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    schema = SCHEMA + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        coder, packer, out = encoder(tokenizer), LevelPacker(window), []

        def emit(held: list) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, total, ids in held:
                out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, ids if with_ids else None))
                offset += len(ids) // 4
            sequence += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())] * with_ids
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    if full := packer.place((doc, start, total, piece), len(piece) // 4):
                        emit(full)
                    if len(out) >= 2000:
                        yield flushed()
        for held in packer.close():
            emit(held)
            if len(out) >= 2000:
                yield flushed()
        if out:
            yield flushed()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(trimmed(run), schema)

