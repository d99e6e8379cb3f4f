"""Token ids of whole texts with a public byte-level BPE vocabulary.

The ids are those of the ``tokenizers`` library without special tokens added.
The vocabulary's split pattern ends a piece before every space or line end
that stands alone between two visible characters, and merges never cross
pieces.  So a text is cut there, each distinct cut is encoded by the library
once, and its ids are kept while a worker runs (up to ``CACHE`` cuts).  A text
goes to the library whole if it holds other white space, the vocabulary's
special token, or a character outside ``_SURE``, for which the pattern may
depend on the Unicode version.
"""

from __future__ import annotations

import os
import re

import numpy as np

from veracity.llm.common import kept

CACHE = 1_000_000
VOCABULARY = "byte_bpe_50k.json"
_SURE = "԰"
_WHOLE = -1
_FIRST = "\x00"  # marks a cut without a space before it
_ODD = re.compile(f"[\\s\x1c-\x1f{_FIRST}{_SURE}-\U0010ffff]").search
_JOINED = 512


class _Cuts(dict):
    """Number of each cut; new ones are listed in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, cut: str) -> int:
        own = cut[1:] if cut[:1] == _FIRST else cut
        if cut == "\n" or own and not _ODD(own):
            self[cut] = k = len(self)
            self.new.append(cut)
            return k
        return _WHOLE


class Encoder:
    """ids(text) -> uint32 array."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._bpe = Tokenizer.from_file(path)
        self._special = tuple(t.content for t in self._bpe.get_added_tokens_decoder().values())
        self._limit = cache
        vocab = self._bpe.get_vocab()
        self._bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self._bytes[i] = len(token)  # a byte is a letter of the vocabulary's alphabet
        self._reset()

    def _reset(self) -> None:
        self._cuts = _Cuts()
        self._flat, self._used = np.empty(1 << 16, np.uint32), 0
        self._start, self._len = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self) -> None:
        """Encode the new cuts, many in one string; where a cut's tokens end
        follows from the bytes that they stand for."""
        new, self._cuts.new = self._cuts.new, []
        texts = ["\n" + c[1:] if c[0] == _FIRST else c if c == "\n" else " " + c for c in new]
        sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        joined = ["".join(texts[at:at + _JOINED]) + " ." for at in range(0, len(texts), _JOINED)]
        made = [e.ids[:-1] for e in self._bpe.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([np.array(m, np.uint32) for m in made])
        ends = np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum(sizes)) + 1
        start = np.concatenate([[0], ends[:-1]])
        start += np.fromiter((c[0] == _FIRST for c in new), np.int64, len(new))  # without the line end put before it
        last, used = len(self._cuts), self._used + len(ids)
        while used > len(self._flat):
            self._flat = np.concatenate([self._flat, np.empty_like(self._flat)])
        while last > len(self._start):
            self._start, self._len = np.concatenate([self._start] * 2), np.concatenate([self._len] * 2)
        self._flat[self._used:used] = ids
        self._start[last - len(new):last] = self._used + start
        self._len[last - len(new):last] = ends - start
        self._used = used

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._bpe.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; none for null or empty ones."""
        if len(self._cuts) > self._limit:
            self._reset()
        numbers = []
        for text in texts:
            if not text:
                numbers.append(np.empty(0, np.int64))
            elif any(s in text for s in self._special):
                numbers.append(np.array([_WHOLE]))
            else:
                cuts = (_FIRST + text.replace("\n", " \n " + _FIRST)).split(" ")
                numbers.append(np.fromiter(map(self._cuts.__getitem__, cuts), np.int64, len(cuts)))
        if self._cuts.new:
            self._learn()
        out = []
        for text, k in zip(texts, numbers, strict=True):
            if not len(k):
                out.append(np.empty(0, np.uint32))
            elif k.min() < 0:
                out.append(self.whole(text))
            else:
                n = self._len[k]
                ends = np.cumsum(n)
                out.append(self._flat[np.repeat(self._start[k] - (ends - n), n) + np.arange(ends[-1])])
        return out

    def ids(self, text: str | None) -> np.ndarray:
        return self.ids_batch([text])[0]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str | None = None, cache: int = CACHE) -> Encoder:
    """This worker's encoder for the vocabulary file ``path``; it goes when another operator's task starts."""
    path = path or vocabulary()
    return kept(f"tokens {path}", lambda: Encoder(path, cache))
