"""Token ids of whole texts by a public vocabulary file, for operators 6 and 9.

``word_bpe_49k`` drops white space before it merges, so the ids of a text are
the ids of its white-space-separated chunks, one after the other.  Each distinct
chunk goes through the ``tokenizers`` library once per worker and is remembered
up to a bound; texts that may hold a special token's string are encoded whole.
``tests/llm`` compares both ways.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import sole

END_ID = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A run of lower-case ASCII or of Latin-1 letters, then ASCII marks: the vocabulary's own splitter parts it in the same place.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
_JOINED = 200


class ChunkEncoder(dict):
    """Chunk -> number of its entry in a flat pool of ids.

    New chunks of plain letters are encoded many at a time, separated by spaces,
    without the normaliser (which leaves them as they are); a letter run with
    marks behind it is the letters' entry followed by the marks'; all other
    chunks take the full tokenizer one by one.
    """

    def __init__(self, path: str | None, bound: int = 400_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path or default_path())
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.bound = bound
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.n = 0
        self.words: list[tuple[int, str]] = []
        self.others: list[tuple[int, str]] = []
        self.pairs: list[tuple[int, int, int]] = []
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)
        self.pool = np.empty(0, self.dtype)

    def __missing__(self, chunk: bytes) -> int:
        m = _PLAIN.fullmatch(chunk)
        if m and m[2]:
            pair = (self[m[1]], self[m[2]])
        at = self[chunk] = self.n
        self.n += 1
        if not m:
            self.others.append((at, chunk.decode("utf-8", "replace")))
        elif m[2]:
            self.pairs.append((at, *pair))
        else:
            self.words.append((at, chunk.decode().lower()))
        return at

    def _settle(self) -> None:
        """Encode what is new and append it to the pool."""
        if self.n == len(self.start):
            return
        known = len(self.start)
        self.start = np.concatenate([self.start, np.zeros(self.n - known, np.int64)])
        self.length = np.concatenate([self.length, np.zeros(self.n - known, np.int64)])
        texts = [w for _, w in self.words]
        groups = [" ".join(texts[i : i + _JOINED]) for i in range(0, len(texts), _JOINED)]
        flat = np.asarray([i for e in self.plain.encode_batch_fast(groups, add_special_tokens=False) for i in e.ids], np.int64)
        stops = np.flatnonzero(self.ends[flat]) + 1 if len(flat) else np.empty(0, np.int64)
        if len(stops) == len(texts):
            self._append([at for at, _ in self.words], flat, np.diff(stops, prepend=0))
        else:  # a vocabulary without word ends
            self.others += self.words
        if self.others:
            found = [e.ids for e in self.tok.encode_batch_fast([c for _, c in self.others], add_special_tokens=False)]
            self._append([at for at, _ in self.others], np.asarray([i for x in found for i in x], np.int64), np.asarray([len(x) for x in found], np.int64))
        if self.pairs:
            at, a, b = np.asarray(self.pairs, np.int64).T
            both = np.stack([a, b], 1).ravel()
            self._append(at, self._gather(both), self.length[a] + self.length[b])
        self.words, self.others, self.pairs = [], [], []

    def _append(self, at, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.start[at] = len(self.pool) + np.cumsum(lengths) - lengths
        self.length[at] = lengths
        self.pool = np.concatenate([self.pool, flat.astype(self.dtype)])

    def _gather(self, at: np.ndarray) -> np.ndarray:
        size = self.length[at]
        first = np.cumsum(size) - size
        return self.pool[np.repeat(self.start[at] - first, size) + np.arange(size.sum())]

    def encode(self, blobs: list[bytes], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, each followed by ``end``; and where each text starts (one more at the end)."""
        if len(self) > self.bound:
            self.clear()
        words: list[bytes] = []
        counts = np.empty(len(blobs), np.int64)
        whole = [i for i, b in enumerate(blobs) if b"<|" in b]
        for i, b in enumerate(blobs):
            w = [] if b"<|" in b else b.lower().split()
            counts[i] = len(w)
            words += w
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self._settle()
        cum = np.concatenate([[0], np.cumsum(self.length[at])])
        flat = self._gather(at)
        ends = cum[np.cumsum(counts)]
        if end is not None:
            flat = np.insert(flat, ends, self.dtype.type(end))
            offsets = np.concatenate([[0], ends + np.arange(1, len(blobs) + 1)])
        else:
            offsets = np.concatenate([[0], ends])
        if whole:
            parts = [flat[offsets[i] : offsets[i + 1]] for i in range(len(blobs))]
            for i in whole:
                ids = self.tok.encode(blobs[i].decode("utf-8", "replace"), add_special_tokens=False).ids
                parts[i] = np.asarray(ids + ([end] if end is not None else []), self.dtype)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            flat = np.concatenate(parts)
        return flat, offsets.astype(np.int64)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str | None) -> ChunkEncoder:
    """The worker process's encoder for a vocabulary file."""
    key = path or ""
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path)
    return sole(_ENCODERS[key])
