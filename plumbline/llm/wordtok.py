"""Batch encoding with a ``tokenizers`` vocabulary, one lookup per distinct word.

The vocabulary drops white space and never joins two words, so a text's ids are the ids of its
words in turn.  A batch is split into words, the distinct ones are encoded by the library, and the
ids are gathered back by array indexing.  Words made only of ASCII and Latin-1 letters need no
Unicode normalisation beyond lower case; every other word goes through the whole library pipeline.
"""

from __future__ import annotations

import gc
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words for which normalisation is lower case alone (no combining marks, no Unicode white space).
PLAIN = r"^[\x21-\x7E\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]*$"
# The split pattern of the vocabulary file word_bpe_49k.json.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gather(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the ragged rows ``index`` of (starts, lengths, values); also returns their lengths."""
    n = lengths[index]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 2**31 else np.int64
    at = np.repeat((starts[index] - (ends - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return values[at], n


class RaggedCache:
    """Strings to id runs, forgotten as a whole beyond ``limit`` strings (a bound on memory, not on results)."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.values = np.zeros(0, np.uint32)

    def lookup(self, words: list[str]) -> np.ndarray:
        if len(self.slots) + len(words) > self.limit:
            self.clear()
        get = self.slots.get
        found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [words[i] for i in missing]
            collects = gc.isenabled()
            gc.disable()  # for the many small lists alone; later stages in this worker need it
            try:
                runs = self.encode(new)
                n = np.fromiter(map(len, runs), np.int64, len(runs))
                flat = np.fromiter((i for r in runs for i in r), np.uint32, int(n.sum()))
                del runs
            finally:
                if collects:
                    gc.enable()
            base = len(self.starts)
            self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(n) - n])
            self.lengths = np.concatenate([self.lengths, n])
            self.values = np.concatenate([self.values, flat])
            found[missing] = np.arange(base, base + len(new))
            self.slots.update(zip(new, range(base, base + len(new)), strict=True))
        return found


class WordEncoder:
    def __init__(self, vocabulary: str, cache_words: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(vocabulary)
        part = Tokenizer.from_file(vocabulary)
        part.normalizer = None
        part.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.parts = RaggedCache(lambda w: [e.ids for e in part.encode_batch_fast(w, add_special_tokens=False)], cache_words)
        self.others = RaggedCache(lambda w: [e.ids for e in self.whole.encode_batch_fast(w, add_special_tokens=False)], cache_words // 4)

    def release(self) -> None:
        """Forget all words: a worker that waits for other work holds no memory of this."""
        self.parts.clear()
        self.others.clear()
        pa.default_memory_pool().release_unused()

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and ids of distinct words."""
        plain = pc.match_substring_regex(words, PLAIN)
        for s in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, s))
        plain = plain.to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(words), np.int64)
        chunks = []
        if plain.any():
            lower = pc.utf8_lower(words.filter(pa.array(plain)))
            spaced = pc.replace_substring_regex(lower, PARTS, r"\0 ")
            lists = pc.ascii_split_whitespace(spaced)
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            d = lists.flatten().dictionary_encode()
            slots = self.parts.lookup(d.dictionary.to_numpy(zero_copy_only=False).tolist())
            ids, n = gather(self.parts.starts, self.parts.lengths, self.parts.values, slots[d.indices.to_numpy()])
            lengths[plain] = np.bincount(of, weights=n, minlength=len(lists)).astype(np.int64)
            chunks.append((np.flatnonzero(plain), ids))
        if not plain.all():
            rest = np.flatnonzero(~plain)
            slots = self.others.lookup(words.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist())
            ids, n = gather(self.others.starts, self.others.lengths, self.others.values, slots)
            lengths[rest] = n
            chunks.append((rest, ids))
        starts, base = np.zeros(len(words), np.int64), 0
        for where, ids in chunks:
            n = lengths[where]
            starts[where] = base + np.cumsum(n) - n
            base += len(ids)
        return starts, lengths, np.concatenate([ids for _, ids in chunks]) if chunks else np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array, slice_bytes: int = 5_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids of all texts; null counts as empty.

        Works through slices of whole texts of about ``slice_bytes``, which bounds memory.
        """
        if len(texts) == 0:
            return np.zeros(1, np.int64), np.zeros(0, np.uint32)
        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(size // slice_bytes, prepend=0)), [0, len(texts)]]))
        done = [self._slice(texts.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        base = np.cumsum([0, *(len(ids) for _, ids in done)])
        offsets = [o[:-1] + b for (o, _), b in zip(done, base[:-1], strict=True)]
        return np.concatenate([*offsets, base[-1:]]), np.concatenate([ids for _, ids in done])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        d = lists.flatten().dictionary_encode()
        index = d.indices.to_numpy()
        ids, n = gather(*self._words(d.dictionary), index)
        ends = np.concatenate([[0], np.cumsum(n)])
        return ends[bounds - bounds[0]], ids


_encoders: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """The process's encoder for a vocabulary; Python workers keep it from task to task, without its words once a task releases them."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]
