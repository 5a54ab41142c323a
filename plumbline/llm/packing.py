"""Order-preserving packing by dynamic programming.

The ids of a partition's documents form one stream, in stored order.  The stream is cut into windows
of at most ``length`` ids.  A cut costs nothing at a document's end, a little at a sentence's end,
more inside a very long sentence, and every window costs its padding; the cheapest cuts follow
from one pass in which a monotone queue holds the best earlier cut within reach.

A block of about ``block`` ids is solved at a time; its last window stays open for the next block,
so memory is bounded and only a partition's last window is cut short.

Defined results: a null text is an empty document, which still has its end id; repeated rows are
packed each; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordtok

LENGTH, END = 4096, 2
SENTENCE, INSIDE = 16, 256
#: A sentence longer than this many ids may be cut inside, after so many ids each.
LONG = 512
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut string"


def cuts(position: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Numbers of the chosen cuts.  position: ascending, first 0, gaps of at most ``length``; the last one is always a cut."""
    p, c = position.tolist(), penalty.tolist()
    back = [0] * len(p)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, number): ascending by both
    for j in range(1, len(p)):
        at = p[j]
        while p[queue[0][1]] < at - length:
            queue.popleft()
        reach, i = queue[0]
        back[j] = i
        total = reach + length - at + c[j]
        key = total + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(p) - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


class Packer:
    """Packs one stream of documents, block by block."""

    def __init__(self, sentence_ids: np.ndarray, first_sequence: int, length: int = LENGTH, block: int = 1 << 19):
        self.marks, self.next, self.length, self.block = sentence_ids, first_sequence, length, block
        self.ids = np.zeros(0, np.uint32)
        self.docs: list[tuple[object, int, int, int]] = []  # id, ids of it in the block, ids of it before, all its ids
        self.pending: list[np.ndarray] = []
        self.size = 0

    def add(self, names: list, lengths: np.ndarray, ids: np.ndarray):
        """Whole documents, end ids included.  Yields tables of pieces."""
        ends = np.cumsum(lengths)
        at = 0
        while at < len(names):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + max(self.block - self.size, 1))))
            self.docs += [(names[i], int(lengths[i]), 0, int(lengths[i])) for i in range(at, to)]
            self.pending.append(ids[before : int(ends[to - 1])])
            self.size += int(ends[to - 1]) - before
            at = to
            if self.size >= self.block:
                yield self.solve(False)

    def boundaries(self, ids: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind = np.zeros(len(ids) + 1, np.int8)
        kind[1:][self.marks[ids]] = 2
        kind[doc_ends] = 3
        known = np.concatenate([[0], np.flatnonzero(kind)])
        known = np.append(known, len(ids)) if known[-1] != len(ids) else known
        step = max(1, min(LONG, self.length // 4))
        for k in np.flatnonzero(np.diff(known) > step):
            kind[known[k] + step : known[k + 1] : step] = 1
        kind[len(ids)] = max(kind[len(ids)], 1)
        at = np.concatenate([[0], np.flatnonzero(kind[1:]) + 1])
        return at, np.array([0, INSIDE, SENTENCE, 0])[kind[at]], kind[at]

    def solve(self, last: bool) -> pa.RecordBatch:
        ids = np.concatenate([self.ids, *self.pending])
        lengths = np.array([d[1] for d in self.docs], np.int64)
        doc_ends = np.cumsum(lengths)
        doc_starts = doc_ends - lengths
        position, penalty, kind = self.boundaries(ids, doc_ends)
        chosen = cuts(position, penalty, self.length)
        if not last:
            chosen = chosen[:-1]
        ends = position[chosen]
        done = int(ends[-1]) if len(ends) else 0
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        a = np.unique(np.concatenate([starts, doc_starts[doc_starts < done]])).astype(np.int64)
        n = np.diff(np.append(a, done)) if len(a) else a
        doc = np.searchsorted(doc_starts, a, side="right") - 1
        seq = np.searchsorted(starts, a, side="right") - 1
        before, total = np.array([d[2] for d in self.docs], np.int64), np.array([d[3] for d in self.docs], np.int64)
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * x : 4 * (x + m)]) for x, m in zip(a.tolist(), n.tolist(), strict=True)]
        kinds = np.array(["start", "inside", "sentence", "document"], object)
        end_kind = np.where(a + n == doc_ends[doc], "document", kinds[kind[np.searchsorted(position, a + n)]]) if len(a) else np.zeros(0, object)
        table = pa.record_batch(
            {
                "doc_id": pa.array([self.docs[i][0] for i in doc.tolist()], pa.int64()),
                "start": pa.array(a - doc_starts[doc] + before[doc], pa.int64()),
                "length": pa.array(n, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(total[doc], pa.int64()),
                "sequence_id": pa.array(self.next + seq, pa.int64()),
                "offset": pa.array(a - starts[seq], pa.int64()),
                "cut": pa.array(end_kind.tolist(), pa.string()),
            }
        )
        self.next += len(starts)
        open_from = int(np.searchsorted(doc_ends, done, side="right"))
        rest = self.docs[open_from:]
        if rest:
            gone = max(0, done - int(doc_starts[open_from]))
            name, m, b, t = rest[0]
            rest[0] = (name, m - gone, b + gone, t)
        self.docs, self.ids, self.pending, self.size = rest, ids[done:], [], len(ids) - done
        return table


def sentence_marks(vocabulary: str) -> np.ndarray:
    """For every id whether its text ends a sentence."""
    from tokenizers import Tokenizer

    pieces = Tokenizer.from_file(vocabulary).get_vocab()
    out = np.zeros(max(max(pieces.values()), END) + 1, bool)
    for piece, i in pieces.items():
        word = piece.removesuffix("</w>")
        out[i] = word != piece and bool(word) and word[-1] in ".!?"
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END, block: int = 1 << 19) -> DataFrame:
    """One row for each piece of a document: where it starts there, where it lies, and what kind of place it ends at."""
    common.prepare(docs.sparkSession)
    vocabulary = vocabulary or wordtok.default_vocabulary()

    def go(batches):
        packer = Packer(sentence_marks(vocabulary), TaskContext.get().partitionId() << 32, length, block)
        encoder = wordtok.encoder(vocabulary)
        for b in batches:
            offsets, ids = encoder.encode(b["text"])
            n = np.diff(offsets)
            whole = np.insert(ids, offsets[1:], end)
            yield from packer.add(b["doc_id"].to_pylist(), n + 1, whole)
        encoder.release()
        if packer.size:
            yield packer.solve(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, SCHEMA)
