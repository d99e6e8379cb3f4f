"""BPE encoding and decoding of whole texts by content-defined chunks.

A rolling hash over the last ``_WINDOW`` bytes says where a text is cut into
chunks, so that a passage gives the same chunks in every document it stands in.

1. The digests of all chunks are counted; those met twice or more are shared.
   A bit map of fixed size tells the tasks which chunks can be (some others too, which changes no result).
2. Each distinct shared chunk is encoded once, into a table of ids by digest.
3. Documents without a shared chunk are finished where they are read.  The
   others become pieces in order: references to shared chunks, and the ids of the text between them.
4. Joins are repaired where the text is at hand: the words that a cut may have
   broken are taken off both chunks and encoded together, and then the words on either side of the new join are
   encoded once with and once without each other.  Where the ids don't agree exactly, the chunk gives
   up another word to the text between, until they do or the chunk is used up.  A reference carries how many
   ids it loses at either end.
5. References meet the table of ids (frequent chunks are dealt over salts), and
   each document's pieces are put together in order.

A position before a blank or a line end parts two words for this kind of vocabulary: its
pieces hold no white space, and neither NFC nor lower-casing reaches across a blank.  That
allows the words of a text to be encoded one by one, each distinct one once in a task (up
to ``_WORDS`` of them or ``_WORD_BYTES`` of text).  The check of the joins gives the library the text on both sides of a cut.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.common import bit_map, ready, stage
from veracity.operators.skew import salted_join

VOCABULARY = "word_bpe_49k.json"
#: A chunk ends where the hash has this many zero bits, after ``MIN_CHUNK`` bytes, or at ``MAX_CHUNK``.
CUT_BITS = 10
MIN_CHUNK = 256
MAX_CHUNK = 8192
FILTER_BITS = 24
_WINDOW_STEPS = 5
_WINDOW = 1 << _WINDOW_STEPS
_SLICE = 1 << 22
_WORDS = 300_000
_WORD_BYTES = 16 << 20
_RUN = 1 << 16
_TABLE = np.random.default_rng(20240311).integers(0, 2**32, 256, dtype=np.uint32)
_CUT = re.compile("[ \n]")
# ---- fixed values: the vocabulary's pattern of pieces, for letters of the ranges that _PLAIN allows
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
# ---- end of fixed values
#: The vocabulary's letter of each byte: its own character where that is visible, else one of those from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _marks(raw: np.ndarray) -> np.ndarray:
    """Positions where the hash of the bytes before asks for a cut."""
    found = []
    for at in range(0, len(raw), _SLICE):
        lo = max(0, at - _WINDOW + 1)
        h = _TABLE[raw[lo:at + _SLICE]]
        m = np.uint32(0x9E3779B1)
        for s in range(_WINDOW_STEPS):
            step = 1 << s
            nxt = h.copy()
            nxt[step:] += h[:-step] * m
            h, m = nxt, m * m
        hit = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + lo + 1
        found.append(hit[(hit > at) & (hit >= _WINDOW)])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 ``data``; never inside a character."""
    raw, out, last = np.frombuffer(data, np.uint8), [], 0

    def cut(p: int) -> int:
        while p < len(raw) and raw[p] & 0xC0 == 0x80:
            p += 1
        out.append(p)
        return p

    with np.errstate(over="ignore"):
        marks = _marks(raw).tolist()
    for p in marks:
        while p - last > MAX_CHUNK:
            last = cut(last + MAX_CHUNK)
        if p - last >= MIN_CHUNK:
            last = cut(p)
    while len(raw) - last > MAX_CHUNK:
        last = cut(last + MAX_CHUNK)
    if last < len(raw):
        out.append(len(raw))
    return out


def digests(data: bytes, ends: list[int]) -> np.ndarray:
    """A row of two longs for each chunk."""
    starts = [0, *ends[:-1]]
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(starts, ends, strict=True)), np.int64).reshape(-1, 2)


class _Known(dict):
    """Packed ids by word; a new word is encoded when it is first asked for.

    Words of ASCII and Latin-1 letters only are cut into the vocabulary's pieces
    here and go to the library's model piece by piece; others go to the whole library.
    """

    def __init__(self, bpe, code: str):
        self._whole, self._model, self._code = bpe, bpe.model, code
        self._special = [t.content for t in bpe.get_added_tokens_decoder().values()]
        if not all("<" in s for s in self._special):
            raise ValueError("special tokens are looked for by their '<'")
        self._pieces: dict[str, bytes] = {}
        self.size = 0

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        self._pieces[piece] = made = array(self._code, [t.id for t in self._model.tokenize(shown)]).tobytes()
        return made

    def __missing__(self, word: str) -> bytes:
        if word and _PLAIN(word) and not ("<" in word and any(s in word for s in self._special)):
            known, packed = self._pieces, b""
            for p in _SPLIT(word.lower()):
                packed += known.get(p) or self._piece(p)
        else:
            packed = array(self._code, self._whole.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = packed
        self.size += len(word)
        return packed

    def clear(self) -> None:
        super().clear()
        self._pieces.clear()
        self.size = 0


class Words:
    """Ids of texts, word by word; a distinct word is encoded once as long as it is kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.bpe = Tokenizer.from_file(path)
        self.bpe.no_truncation()
        self.bpe.no_padding()
        vocab = self.bpe.get_vocab(with_added_tokens=True)
        wide = max(vocab.values()) > 0xFFFF
        self.kind, self.code = (np.dtype(np.uint32), "I") if wide else (np.dtype(np.uint16), "H")
        self.tokens: list[str] = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self._known = _Known(self.bpe, self.code)

    def whole(self, text: str) -> bytes:
        """The library's own ids of a text, packed."""
        return array(self.code, self.bpe.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Packed ids of a text."""
        if len(self._known) > _WORDS or self._known.size > _WORD_BYTES:
            self._known.clear()
        return b"".join(map(self._known.__getitem__, text.replace("\n", " ").split(" ")))

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [self.ids(t) for t in texts]

    def unpack(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.kind)

    def decode(self, ids) -> str:
        """What the library's decode gives for a vocabulary without a decoder: the tokens with blanks between."""
        return " ".join([self.tokens[i] for i in ids])


class Digest:
    """Number of ids, and the hashes of the ids and of the decoded text, of a document given in parts."""

    def __init__(self, words: Words):
        self.words, self.n = words, 0
        self.ids, self.text = hashlib.sha256(), hashlib.sha256()

    def add(self, packed: bytes) -> None:
        all_ids = self.words.unpack(packed)
        for at in range(0, len(all_ids), _RUN):
            ids = all_ids[at:at + _RUN]
            self.ids.update(ids.astype("<u4").tobytes())
            self.text.update(((" " if self.n else "") + self.words.decode(ids.tolist())).encode())
            self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def _first_cut(text: str, at: int = 0) -> int:
    """Where the first word that begins with a blank or a line end starts, -1 if none does."""
    m = _CUT.search(text, at)
    return m.start() if m else -1


def _last_cut(text: str, end: int) -> int:
    return max(text.rfind(" ", 0, end), text.rfind("\n", 0, end))


class Repair:
    """Turns the chunks of a text into references and the text between them."""

    def __init__(self, words: Words):
        self.words = words
        self._seen: dict[tuple[str, str], bool] = {}

    def agree(self, left: str, right: str) -> bool:
        """Both sides' ids are the same with and without each other."""
        if not left or not right:
            return True
        if (left, right) not in self._seen:
            if len(self._seen) > _WORDS // 4:
                self._seen.clear()
            whole = self.words.whole
            self._seen[left, right] = whole(left + right) == whole(left) + whole(right)
        return self._seen[left, right]

    @staticmethod
    def _last_word(text: str) -> str:
        return text[max(_last_cut(text, len(text)), 0):]

    @staticmethod
    def _first_word(text: str) -> str:
        end = _first_cut(text, 1)
        return text if end < 0 else text[:end]

    def pieces(self, text: str, bounds: list[tuple[int, int, bool]]) -> list[tuple[int, int, int | None]]:
        """(start, end, chunk): the parts of the text in order; chunk is the
        number of the shared chunk that a part lies in, None for text between.

        ``bounds`` are the chunks (start, end, shared) in characters."""
        refs = []
        for k, (a, b, shared) in enumerate(bounds):
            if not shared:
                continue
            lo = a if a == 0 else _first_cut(text[a:b])
            hi = b if b == len(text) else _last_cut(text[a:b], b - a)
            lo, hi = (lo if a == 0 else lo + a if lo >= 0 else b), (hi if b == len(text) else hi + a if hi >= 0 else a)
            if lo < hi:
                refs.append([lo, hi, k])
        done, prev = [], None  # prev: the last reference kept
        for i, ref in enumerate(refs):
            before = prev[1] if prev else 0
            # the start of this reference, against the text (or the reference) before it
            while ref[0] < ref[1] and ref[0] > 0 and not self.agree(self._last_word(text[before:ref[0]] or text[prev[0]:prev[1]]), self._first_word(text[ref[0]:ref[1]])):
                nxt = _first_cut(text[ref[0]:ref[1]], 1)
                ref[0] = ref[1] if nxt < 0 else ref[0] + nxt
            if ref[0] >= ref[1]:
                continue
            after = refs[i + 1][0] if i + 1 < len(refs) else len(text)
            # its end, against the text after it; an end that touches the next reference is checked as that one's start
            while ref[0] < ref[1] and ref[1] < after and not self.agree(self._last_word(text[ref[0]:ref[1]]), self._first_word(text[ref[1]:after])):
                cut = _last_cut(text[ref[0]:ref[1]], ref[1] - ref[0])
                ref[1] = ref[0] + max(cut, 0)
            if ref[0] < ref[1]:
                if ref[0] > before:
                    done.append((before, ref[0], None))
                done.append((ref[0], ref[1], ref[2]))
                prev = ref
        last = prev[1] if prev else 0
        if last < len(text):
            done.append((last, len(text), None))
        return done


def _runs(text: str, lo: int, hi: int) -> list[str]:
    """The text from lo to hi in parts of about ``_RUN`` characters that begin before blanks."""
    out = []
    while hi - lo > _RUN:
        end = max(text.rfind(" ", lo + 1, lo + _RUN), text.rfind("\n", lo + 1, lo + _RUN))
        if end <= lo:
            m = _CUT.search(text, lo + _RUN, hi)
            end = m.start() if m else hi
        out.append(text[lo:end])
        lo = end
    out.append(text[lo:hi])
    return out


def _count_chunks(batches):
    for batch in batches:
        found: dict[bytes, int] = {}
        for text in batch.column(0):
            data = text.as_py()
            if data:
                raw, at = data.encode(), 0
                for end in cuts(raw):
                    h = xxhash.xxh3_128_digest(raw[at:end])
                    found[h] = found.get(h, 0) + 1
                    at = end
        h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(found.values()), pa.int64())], names=["h1", "h2", "n"])


def _flags(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h[:, 0] & ((1 << FILTER_BITS) - 1)
    return (bits[at >> 6] >> (at & 63) & 1).astype(bool)


def _shared_texts(bits):
    def run(batches):
        for batch in batches:
            found: dict[tuple[int, int], bytes] = {}
            for text in batch.column(0):
                data = (text.as_py() or "").encode()
                ends = cuts(data)
                if ends:
                    h = digests(data, ends)
                    for i in np.flatnonzero(_flags(bits.value, h)).tolist():
                        found[int(h[i, 0]), int(h[i, 1])] = data[ends[i - 1] if i else 0:ends[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array([v.decode() for v in found.values()], pa.string())],
                names=["h1", "h2", "text"])

    return run


def _encode_chunks(path: str):
    def run(batches):
        words = Words(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words.ids_of(batch.column(2).to_pylist()), pa.binary())], names=["h1", "h2", "ids"])

    return run


_PIECES = ("doc_id long, row long, at int, n_tokens long, ids_sha256 string, decoded_sha256 string, "
           "ids binary, h1 long, h2 long, lose_head int, lose_tail int")


def _cut_pieces(path: str, bits):
    """Rows of documents: finished ones (at null), else their pieces."""
    def run(batches):
        from pyspark import TaskContext

        words = Words(path)
        repair, row, width = Repair(words), TaskContext.get().partitionId() << 40, words.kind.itemsize
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, row = text.as_py() or "", row + 1
                data = text.encode()
                ends = cuts(data)
                h = digests(data, ends) if ends else np.empty((0, 2), np.int64)
                shared = _flags(bits.value, h)
                parts = [(0, len(text), None)]
                if shared.any():
                    plain = len(data) == len(text)
                    at, bounds = 0, []
                    for a, b, s in zip([0, *ends[:-1]], ends, shared.tolist(), strict=True):
                        size = b - a if plain else len(data[a:b].decode())
                        bounds.append((at, at + size, s))
                        at += size
                    parts = repair.pieces(text, bounds)
                if all(k is None for _, _, k in parts):
                    whole = Digest(words)
                    for ids in words.ids_of(_runs(text, 0, len(text))):
                        whole.add(ids)
                    out.append((doc_id, None, None, *whole.row(), None, None, None, None, None))
                    continue
                at = 0
                for a, b, k in parts:
                    if k is None:
                        for ids in words.ids_of(_runs(text, a, b)):
                            out.append((doc_id, row, at, None, None, None, ids, None, None, None, None))
                            at += 1
                    else:
                        lost = words.ids_of([text[bounds[k][0]:a], text[b:bounds[k][1]]])
                        out.append((doc_id, row, at, None, None, None, None, int(h[k, 0]), int(h[k, 1]), *(len(x) // width for x in lost)))
                        at += 1
            cols = list(zip(*out, strict=True)) if out else [()] * 11
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _PIECES.split(", ")])

    return run


def _assemble(path: str):
    """Finished documents from their pieces, which come in order, those of a document one after the other."""
    def run(batches):
        words = Words(path)
        width, open_, doc, whole, done = words.kind.itemsize, None, None, None, []

        def rows():
            cols = list(zip(*done, strict=True)) if done else [()] * 4
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                                              names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            for row, doc_id, ids, head, tail in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if row != open_:
                    if whole is not None:
                        done.append((doc, *whole.row()))
                    open_, doc, whole = row, doc_id, Digest(words)
                whole.add(ids[head * width:len(ids) - tail * width])
            yield rows()
        if whole is not None:
            done.append((doc, *whole.row()))
        yield rows()

    return run


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row: of the ids of
    the whole text by the vocabulary file ``path``, and of the text decoded from them.

    Null and empty texts have no ids.  Repeated rows and rows of one id or without an id
    come back as often as they are given, each from its own text.  Very long texts are worked
    through in parts; only the text itself is held.  A text without blanks is one word and
    encoded as a whole.  Special tokens written in a text are taken as the library takes them.  An empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ready(spark)
    path = path or vocabulary()
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = texts.select("text").mapInArrow(_count_chunks, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    shared = stage(counts.where("n > 1"), "shared")
    bits = spark.sparkContext.broadcast(bit_map(shared, F.col("h1").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), FILTER_BITS))
    once = texts.select("text").mapInArrow(_shared_texts(bits), "h1 long, h2 long, text string").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    # chunks that only share a bit with a shared one are met once
    known = once.mapInArrow(_encode_chunks(path), "h1 long, h2 long, ids binary").join(shared, ["h1", "h2"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    known = stage(known, "chunk-ids")
    made = stage(texts.mapInArrow(_cut_pieces(path, bits), _PIECES), "pieces")
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    refs = made.where("h1 is not null").select("row", "at", "doc_id", "h1", "h2", "lose_head", "lose_tail")
    found = salted_join(refs, known.drop("n"), ["h1", "h2"], known.select("h1", "h2", "n"), "n", ["row", "at"]).select("row", "at", "doc_id", "ids", "lose_head", "lose_tail")
    own = made.where("ids is not null").select("row", "at", "doc_id", "ids", F.lit(0).alias("lose_head"), F.lit(0).alias("lose_tail"))
    ordered = found.unionByName(own).repartition("row").sortWithinPartitions("row", "at").select("row", "doc_id", "ids", "lose_head", "lose_tail")
    whole = ordered.mapInArrow(_assemble(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.where("n_tokens is not null").select(*columns).unionByName(whole.select(*columns))
