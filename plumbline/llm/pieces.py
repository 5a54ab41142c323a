"""SentencePiece encoding and decoding by streaming Viterbi.

``Viterbi`` walks over the characters of a normalised text.  For each position it keeps a back
pointer, the length of the last piece of the best path to there.  A path can only be extended from
positions within the longest piece, so as soon as the back pointers of that window meet in one
boundary, everything before it is final: its ids are handed out and forgotten.

For a unigram vocabulary the best path has the largest sum of scores.  For a byte-pair vocabulary
(the kind at hand) the sum of scores doesn't give the library's ids.  There a path is allowed if
every two neighbouring pieces are what merging yields for their joint text; exactly one path to
each position is, and it is the merge result.  The lattice, the window and the commits are the same.

In this vocabulary no piece joins two words or lines, so at the end of every word all paths meet in
one boundary and what lies before is committed.  What lies between two such boundaries is walked once
and remembered, in a memory of bounded size; vocabularies whose pieces cross spaces are walked over
whole texts.  Inside a word, however long, the window and the commits bound what is held.

Defined results: null and empty texts have no ids; characters outside the vocabulary become byte
pieces (or the unknown id, if there are none); repeated texts get equal ids; an empty table gives an
empty result; columns other than those named keep their values.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .wordtok import RaggedCache, gather

SPACE = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = raw[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


class Pieces:
    """A vocabulary: pieces, scores, byte pieces, and whether it merges pairs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            settings = [v for k, v in fields(f.read()) if k == 2]
        kinds = [v for s in settings for k, v in fields(s) if k == 3]
        self.merges = bool(kinds) and kinds[-1] == 2
        self.size = model.get_piece_size()
        self.id_of: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        self.text: list[bytes] = []
        self.unknown = model.unk_id()
        for i in range(self.size):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.text.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.text.append(b"" if model.is_control(i) else " ⁇ ".encode())
            else:
                self.id_of[p], self.score[p] = i, model.get_score(i)
                self.text.append(p.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.id_of), default=1)
        self.unknown_score = min(self.score.values(), default=0.0) - 10.0
        self.word_bound = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.line_bound = not any("\n" in p for p in self.id_of)

    def ids(self, piece: str) -> list[int]:
        if piece in self.id_of:
            return [self.id_of[piece]]
        return [self.byte_id[b] for b in piece.encode()] if self.byte_id else [self.unknown]


class Viterbi:
    def __init__(self, pieces: Pieces, every: int = 64):
        self.p, self.every = pieces, every
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """What merging the best-scored pair again and again, the first of equals, leaves of a short text."""
        parts, score = list(text), self.p.score
        while len(parts) > 1:
            best = max(((score.get(parts[k] + parts[k + 1], -np.inf), -k) for k in range(len(parts) - 1)))
            if best[0] == -np.inf:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def neighbours(self, a: str, b: str) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            found = self.fits[a, b] = self.merged(a + b) == [a, b]
        return found

    def stream(self, text: str) -> Iterator[str]:
        """The pieces of a normalised text, handed out as soon as they are final."""
        score, longest, merges = self.p.score, self.p.longest, self.p.merges
        base, back, best = 0, [0], [0.0]  # of the positions from base on
        for i in range(1, len(text) + 1):
            found, top = 1, None
            for n in range(min(longest, i - base), 0, -1):
                piece = text[i - n : i]
                known = piece in score
                if not known and n > 1:
                    continue
                at = i - n - base
                if merges:
                    if back[at] == 0 or self.neighbours(text[i - n - back[at] : i - n], piece):
                        found = n
                        break
                else:
                    total = best[at] + (score[piece] if known else self.p.unknown_score)
                    if top is None or total > top:
                        found, top = n, total
            back.append(found)
            best.append(top or 0.0)
            if i - base >= self.every + longest and i % self.every == 0:
                meet = self.meeting(back, base, i)
                yield from self.path(text, back, base, meet)
                # the piece before the boundary stays in sight for the next neighbour test
                back, best, base = back[meet - base :], best[meet - base :], meet
        yield from self.path(text, back, base, len(text))

    def meeting(self, back: list[int], base: int, i: int) -> int:
        """The last boundary that the paths of all positions still in reach share."""
        live = set(range(i - self.p.longest + 1, i + 1))
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(max(base, far - back[far - base]))
        return live.pop()

    def path(self, text: str, back: list[int], base: int, end: int) -> list[str]:
        out = []
        while end > base:
            n = back[end - base]
            out.append(text[end - n : end])
            end -= n
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        """Ids of a text that is already normalised."""
        return [i for piece in self.stream(text) for i in self.p.ids(piece)]


class Codec:
    """Encodes and decodes batches."""

    def __init__(self, path: str, cache_words: int = 1_500_000):
        self.p = Pieces(path)
        self.v = Viterbi(self.p)
        self.cache = RaggedCache(lambda words: [self.v.encode(w) for w in words], cache_words)
        n = np.fromiter(map(len, self.p.text), np.int64, self.p.size)
        self.byte_starts, self.byte_counts = np.cumsum(n) - n, n
        self.byte_values = np.frombuffer(b"".join(self.p.text), np.uint8)

    def normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def words(self, text: str) -> list[str]:
        """Runs of a normalised text that no piece crosses."""
        return re.findall(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+", text) if self.p.word_bound and self.p.line_bound else [text]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(1, np.int64), np.zeros(0, np.uint32)
        odd = pc.or_(pc.match_substring_regex(texts, f"^ |  | \\n|{SPACE}"), pc.equal(texts, ""))
        odd = odd.to_numpy(zero_copy_only=False) | (not (self.p.word_bound and self.p.line_bound))
        lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
        d = lists.flatten().dictionary_encode()
        words = [w if w[:1] == "\n" else SPACE + w for w in d.dictionary.to_numpy(zero_copy_only=False).tolist()]
        slots = self.cache.lookup(words)
        ids, n = gather(self.cache.starts, self.cache.lengths, self.cache.values, slots[d.indices.to_numpy()]) if len(words) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        ends = np.concatenate([[0], np.cumsum(n)])
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = ends[bounds - bounds[0]]
        lengths = np.zeros(len(texts), np.int64)
        lengths[~odd] = np.diff(bounds)
        if not odd.any():
            return bounds, ids
        own: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(odd).tolist():
            words = self.words(self.normal(texts[k].as_py()))
            slots = self.cache.lookup(words)
            own[k] = gather(self.cache.starts, self.cache.lengths, self.cache.values, slots)[0]
            lengths[k] = len(own[k])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros(int(offsets[-1]), np.uint32)
        out[np.repeat(~odd, lengths)] = ids
        for k, v in own.items():
            out[offsets[k] : offsets[k + 1]] = v
        return offsets, out

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of all id runs: the bytes of the pieces joined, without the space put in front."""
        raw, n = gather(self.byte_starts, self.byte_counts, self.byte_values, ids.astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(n)])[offsets]
        data = raw.tobytes()
        out = []
        for a, b, first in zip(ends[:-1].tolist(), ends[1:].tolist(), offsets[:-1].tolist(), strict=True):
            lead = a < b and self.p.text[int(ids[first])][:1] == b" "
            out.append(data[a + lead : b].decode("utf-8", "replace"))
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def slices(texts: pa.Array, size: int = 5_000_000) -> Iterator[pa.Array]:
    """Runs of whole texts of about ``size`` bytes."""
    if len(texts):
        total = np.cumsum(pc.binary_length(pc.fill_null(texts, "")).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(total // size, prepend=0)), [0, len(texts)]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield texts.slice(a, b - a)


def encode_frame(docs, vocabulary: str | None = None):
    """doc_id, text and ``ids`` (array of int) of every document."""
    from . import common

    common.prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def go(batches):
        for b in batches:
            at = 0
            for texts in slices(b["text"]):
                offsets, ids = codec(path).encode(texts)
                rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.record_batch({"doc_id": b["doc_id"].slice(at, len(texts)), "text": texts, "ids": rows})
                at += len(texts)

    return common.columns(docs, "doc_id", "text").mapInArrow(go, "doc_id long, text string, ids array<int>")


def decode_frame(rows, vocabulary: str | None = None):
    """doc_id and ``decoded`` of rows that hold ``ids``."""
    from . import common

    common.prepare(rows.sparkSession)
    path = vocabulary or default_vocabulary()

    def go(batches):
        for b in batches:
            runs = b["ids"].fill_null([])
            offsets = runs.offsets.to_numpy().astype(np.int64)
            ids = runs.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            yield pa.record_batch({"doc_id": b["doc_id"], "decoded": pa.array(codec(path).decode(offsets - offsets[0], ids), pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(go, "doc_id long, decoded string")


def round_trip(docs, vocabulary: str | None = None):
    """Per document: ids' number and crc32, and crc32 of the text and of what its ids decode to; ids and texts stay in the task."""
    import zlib

    from pyspark.sql import functions as F

    from . import common

    common.prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def go(batches):
        for b in batches:
            at = 0
            for texts in slices(b["text"]):
                c = codec(path)
                offsets, ids = c.encode(texts)
                back = c.decode(offsets, ids)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                o = (4 * offsets).tolist()
                yield pa.record_batch(
                    {
                        "doc_id": b["doc_id"].slice(at, len(texts)),
                        "n_tokens": np.diff(offsets),
                        "ids_crc32": pa.array([zlib.crc32(raw[x:y]) for x, y in zip(o[:-1], o[1:], strict=True)], pa.int64()),
                        "text_crc32": pa.array([zlib.crc32(t.encode()) for t in pc.fill_null(texts, "").to_pylist()], pa.int64()),
                        "decoded_crc32": pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                    }
                )
                at += len(texts)

    out = common.columns(docs, "doc_id", "text").mapInArrow(go, "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long, decoded_crc32 long")
    return out.withColumn("round_trip", F.col("text_crc32") == F.col("decoded_crc32"))
