"""Token ids in files compressed with Re-Pair grammars.

A shard holds the ids of consecutive documents.  Its grammar is built by
rounds: pairs of neighbouring symbols are counted, those seen at least
``MIN_COUNT`` times (the ``PER_ROUND`` most frequent) become new symbols, and
their occurrences are replaced from left to right, until no pair is frequent
enough.  A pair of old symbols can only get rarer, so after the first round only
places next to a replacement and those of frequent pairs that are left are
counted again.  Pairs never cross a document's end, so each document can be
decoded alone.

File format (little-endian; arrays are preceded by nothing, their sizes follow
from the header):

    8 bytes   magic "RPTOKEN1"
    4 x u32   documents d, rules r, first rule's symbol t, bits a symbol b
    u64       symbols s of all documents
    i64 x d   document ids, smallest i64 for null
    u64 x d   ids of each document
    u64 x d   symbols of each document
    u32 x 2r  the two symbols of each rule; a rule names only earlier ones
    u32 x r   expansion length of each rule
    bytes     s symbols of b bits each, low bits first; groups of eight fill whole bytes

The prefix sums of the counts give the place of any document's symbols, and
the expansion lengths that of any id in them, without decoding what is before.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.llm.common import read_file, ready, stage, work_path, write_file
from veracity.llm.tokens import encoder, vocabulary

MAGIC = b"RPTOKEN1"
END_ID = 0
SHARD_IDS = 1 << 20
READ_SHARDS = 8  # that a task reads
CACHE = 1_500_000
MIN_COUNT = 16
PER_ROUND = 4096
_NULL = -(2**63)
_SLOTS = 20
_HASH = np.uint64(0x9E3779B97F4A7C15)


def _frequent(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, which, chosen): the places of pair codes seen at least MIN_COUNT times, the place in
    ``chosen`` of each or -1, and the PER_ROUND most frequent of these codes."""
    slot = ((codes * _HASH) >> np.uint64(64 - _SLOTS)).astype(np.int64)
    # a slot's count is at least that of each of its pairs
    at = np.flatnonzero((np.bincount(slot, minlength=1 << _SLOTS) >= MIN_COUNT)[slot])
    pair, which, n = np.unique(codes[at], return_inverse=True, return_counts=True)
    often = np.flatnonzero(n >= MIN_COUNT)
    order = often[np.argsort(-n[often], kind="stable")[:PER_ROUND]]
    number = np.full(len(pair), -1, np.int64)
    number[order] = np.arange(len(order))
    stay = (n >= MIN_COUNT)[which]
    return at[stay], number[which[stay]], pair[order]


def compress(ids: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends of documents in them, rules) of ids whose documents end
    at ``ends``; rules are numbered from ``first``, above every id."""
    seq, rules, n_rules = ids.astype(np.uint32), [], 0
    n = len(seq)
    # the places of the symbols before and after; n stands for none in this document
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    after[ends[ends > 0] - 1] = n
    before[begins[begins < n]] = n
    live = np.ones(n, bool)
    places = np.flatnonzero(after[:n] < n)  # where a pair begins that may be frequent, ascending
    while len(places):
        codes = (seq[places].astype(np.uint64) << np.uint64(32)) | seq[after[places]]
        often, which, chosen = _frequent(codes)
        if not len(chosen):
            break
        places = places[often]
        hit, own = places[which >= 0], which[which >= 0]
        # of hits that overlap, take every other one from the left
        start = np.append(True, after[hit[:-1]] != hit[1:])
        run = np.flatnonzero(start)[np.cumsum(start) - 1]
        taken = (np.arange(len(hit)) - run) % 2 == 0
        hit, own = hit[taken], own[taken]
        seen = np.bincount(own, minlength=len(chosen)) > 0
        used, number = np.flatnonzero(seen), np.cumsum(seen) - 1
        pair = chosen[used]
        rules.append(np.stack([pair >> np.uint64(32), pair & np.uint64(2**32 - 1)], axis=1).astype(np.uint32))
        seq[hit] = (first + n_rules + number[own]).astype(np.uint32)
        n_rules += len(used)
        gone = after[hit]
        live[gone] = False
        after[hit] = after[gone]
        before[after[hit]] = hit
        # pairs that are new, and frequent ones that are left
        again = np.zeros(n + 1, bool)
        again[places] = again[hit] = again[before[hit]] = True
        again[gone] = False
        places = np.flatnonzero(again[:n])
        places = places[after[places] < n]
    new_ends = np.cumsum(live)[ends - 1] if n else np.zeros(len(ends), np.int64)
    return seq[live], np.where(ends > 0, new_ends, 0), (np.concatenate(rules) if rules else np.empty((0, 2), np.uint32))


def _pack_bits(symbols: np.ndarray, bits: int) -> bytes:
    """Eight symbols of ``bits`` bits fill ``bits`` bytes, low bits first."""
    n = -(-len(symbols) // 8)
    wide = np.zeros((n, 8), np.uint64)
    wide.reshape(-1)[:len(symbols)] = symbols
    out = np.zeros((n, bits + 8), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        v = wide[:, k] << np.uint64(shift)
        for j in range(-(-(bits + shift) // 8)):
            out[:, byte + j] |= (v >> np.uint64(8 * j)).astype(np.uint8)
    return out[:, :bits].tobytes()


def _unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    padded = data + bytes(8)
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from every byte on
    at = np.arange(n, dtype=np.int64) * bits
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each symbol stands for."""
    lengths = np.ones(first + len(rules), np.int64)
    while len(rules):
        new = lengths[rules[:, 0]] + lengths[rules[:, 1]]
        if (new == lengths[first:]).all():
            break
        lengths[first:] = new
    return lengths


def encode_shard(doc_ids: list[int | None], docs: list[np.ndarray], first: int) -> bytes:
    """The bytes of a shard file."""
    n = np.array([len(d) for d in docs], "<u8")
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    symbols, ends, rules = compress(ids, np.cumsum(n).astype(np.int64), first)
    bits = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
    return b"".join([
        MAGIC, struct.pack("<IIIIQ", len(docs), len(rules), first, bits, len(symbols)),
        np.array([_NULL if i is None else i for i in doc_ids], "<i8").tobytes(), n.tobytes(),
        np.diff(ends, prepend=0).astype("<u8").tobytes(), rules.astype("<u4").tobytes(),
        _expansion_lengths(rules, first)[first:].astype("<u4").tobytes(), _pack_bits(symbols, bits)])


class Shard:
    """Random access to the documents of a shard file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        d, r, self.first, self._bits, s = struct.unpack_from("<IIIIQ", data, 8)
        at = 8 + 24

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids = [None if i == _NULL else int(i) for i in take("<i8", d)]
        self.n_ids = take("<u8", d).astype(np.int64)
        self._ends = np.cumsum(take("<u8", d).astype(np.int64))
        rules = take("<u4", 2 * r).reshape(-1, 2)
        lengths = take("<u4", r).astype(np.int64)
        self._symbols = _unpack_bits(data[at:], s, self._bits)
        # every symbol's ids in one array; terminals stand for themselves
        self._len = np.concatenate([np.ones(self.first, np.int64), lengths])
        self._start = np.cumsum(self._len) - self._len
        self._flat = np.zeros(int(self._len.sum()), np.uint32)
        self._flat[:self.first] = np.arange(self.first)
        ready = np.arange(len(self._len)) < self.first
        while not ready.all():
            new = np.flatnonzero(ready[rules[:, 0]] & ready[rules[:, 1]] & ~ready[self.first:])
            if not len(new):
                raise ValueError("a rule names a later one")
            at = self._expand(rules[new].ravel())
            to = self._start[self.first + new]
            size = self._len[self.first + new]
            ends = np.cumsum(size)
            self._flat[np.repeat(to - (ends - size), size) + np.arange(ends[-1])] = at
            ready[self.first + new] = True

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self._len[symbols]
        ends = np.cumsum(n)
        return self._flat[np.repeat(self._start[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def document(self, i: int) -> np.ndarray:
        """The ids of the shard's i-th document."""
        return self._expand(self._symbols[self._ends[i - 1] if i else 0:self._ends[i]])


def write(docs: DataFrame, end_id: int = END_ID, path: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of all texts, in ascending order of doc_id, to shard files
    in the shared folder.  The manifest returned (part, seq, path, n_docs,
    n_tokens) lists the files of the attempts that succeeded, a row each;
    (part, seq) orders them.

    A null text counts as empty and has the end id alone; null ids come first;
    rows of one id stand in any order.  No rows give no files.
    """
    spark = docs.sparkSession
    ready(spark)
    path, folder = path or vocabulary(), work_path(spark, "tokens")

    def run(batches):
        bpe, part, seq = encoder(path, CACHE), TaskContext.get().partitionId(), 0
        first = max(len(bpe._bytes), end_id + 1)
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal seq, size
            uri = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.rpt"
            write_file(uri, encode_shard(ids, held, first))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": uri, "n_docs": len(ids), "n_tokens": size}])
            seq, size = seq + 1, 0
            ids.clear()
            held.clear()
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                for doc_id, d in zip(own.column(0).to_pylist(), bpe.ids_batch(own.column(1).to_pylist()), strict=True):
                    ids.append(doc_id)
                    held.append(np.append(d, np.uint32(end_id)))
                    size += len(d) + 1
                    if size >= shard_ids:
                        yield flush()
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return stage(ordered.mapInArrow(run, "part long, seq long, path string, n_docs long, n_tokens long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files.

    start counts the ids of all documents before it in the order of writing.
    """
    files = manifest.count()  # a row for each file, not for each document
    based = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part", "seq")) - F.col("n_tokens"))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(read_file(path))
                n = shard.n_ids
                crc = [zlib.crc32(shard.document(i).astype("<u4")) for i in range(len(n))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(base + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.select("path", "base").repartition(-(-max(1, files) // READ_SHARDS)).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
