"""Retrieval packing: fill each window with unused BM25 neighbours of its seed document.

Documents are dealt to index shards of bounded size by a lexical key (the least hash over
their token pairs), so that near copies meet, with ties broken by content, so that any
number of copies splits evenly. Each shard builds an inverted BM25 index over token ids;
document frequencies and the mean length cover the whole corpus. The seed takes the
window first, then its best unused neighbours by score; the last one is cut where the
window is full and its rest seeds the next window, so only a shard's end is not full. That
end is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import as_batch, cut, keyed, small_batches

WINDOW = 2048
#: Documents that one index shard holds, and bytes of ids from which it holds no more.
SHARD_DOCS, SHARD_BYTES = 512, 64 << 20
K1, B = 1.2, 0.75

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The vocabulary of a byte-level BPE file as an encoder, one for each file and process: text -> ids, added tokens included."""
    import tiktoken

    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: i for i, c in enumerate(byte_alphabet())}
        from public_tokenizers import PATTERN

        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        _loaded[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})
    return _loaded[path]


TOKENS = pa.schema([("doc_id", pa.int64()), ("shard_key", pa.int64()), ("tie", pa.int64()), ("ids", pa.binary())])


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, shard_key, tie, ids): ids as little-endian unsigned 32 bits, ``end_id`` last."""

    def run(batches):
        enc, end = encoder(path), np.array([end_id], np.uint32)
        for b in small_batches(batches):
            ids = [np.append(enc.encode_to_numpy(t or "", allowed_special="all", disallowed_special=()), end).astype("<u4", copy=False) for t in b.column(1).to_pylist()]
            keys, ties = [], []
            for x in ids:
                pair = (x[:-1].astype(np.uint64) << np.uint64(32) | x[1:]) * np.uint64(0x9E3779B97F4A7C15)
                keys.append(int((pair ^ pair >> np.uint64(29)).min() >> np.uint64(1)) if len(pair) else 0)
                ties.append(zlib.crc32(x.tobytes()))
            yield as_batch(TOKENS, b.column(0), keys, ties, [x.tobytes() for x in ids])

    return keyed(docs).mapInArrow(run, "doc_id long, shard_key long, tie long, ids binary")


def frequencies(tokens: DataFrame) -> DataFrame:
    """(token, df, tokens): in how many documents each token id occurs, and how often. As many rows as the vocabulary at most."""
    schema = pa.schema([("token", pa.int32()), ("df", pa.int64()), ("n", pa.int64())])

    def run(batches):
        df = n = np.zeros(0, np.int64)
        seen = np.zeros(0, bool)
        for b in small_batches(batches):
            ids = [np.frombuffer(x.as_buffer(), "<u4") for x in b.column(0)]
            c = np.bincount(np.concatenate(ids) if ids else np.zeros(0, np.int64), minlength=len(n))
            n, df, seen = (np.pad(v, (0, len(c) - len(v))) for v in (n, df, seen))
            n += c
            for x in ids:
                seen[x] = True
                own = np.flatnonzero(seen)
                df[own] += 1
                seen[own] = False
        at = np.flatnonzero(n)
        yield as_batch(schema, at.astype(np.int32), df[at], n[at])

    return tokens.select("ids").mapInArrow(run, "token int, df long, n long").groupBy("token").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


class Index:
    """Inverted BM25 index over the token ids of one shard's documents."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.terms, docs, tf = [], [], []
        for d, x in enumerate(ids):
            t, c = np.unique(x, return_counts=True)
            self.terms.append(t)
            docs.append(np.full(len(t), d, np.int32))
            tf.append(c / (c + K1 * (1 - B + B * len(x) / mean)) * (K1 + 1))
        t, docs, tf = np.concatenate(self.terms), np.concatenate(docs), np.concatenate(tf)
        order = np.argsort(t, kind="stable")
        t, self.docs, self.weight = t[order], docs[order], tf[order] * idf[t[order]]
        self.at = np.searchsorted(t, np.arange(len(idf) + 1))
        self.n = len(ids)

    def scores(self, d: int) -> np.ndarray:
        """BM25 of every document for all of document ``d``'s distinct tokens."""
        t = self.terms[d]
        start, size = self.at[t], self.at[t + 1] - self.at[t]
        take = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.docs[take], self.weight[take], self.n)


def filled(sizes: list[int], ranked, window: int):
    """Windows of one shard as lists of (document, start, length); ``ranked(d)`` gives documents, best neighbour first.

    Every token is placed once. All windows but the last are full.
    """
    out, now, free, used, next_seed, unplaced = [], [], window, np.zeros(len(sizes), bool), 0, sum(sizes)
    rest: tuple[int, int] | None = None  # what the last window had no room for seeds the next
    queue: list[int] = []
    while unplaced:
        if rest is not None:
            d, start = rest
        else:
            d = next((x for x in queue if not used[x]), None) if now else None
            if d is None:
                while used[next_seed]:
                    next_seed += 1
                d = next_seed
            start, used[d] = 0, True
        seeds = not now
        length = min(free, sizes[d] - start)
        now.append((d, start, length))
        unplaced, free = unplaced - length, free - length
        rest = (d, start + length) if start + length < sizes[d] else None
        if not free:
            out.append(now)
            now, free, queue = [], window, []
        elif seeds and unplaced:
            queue = iter(ranked(d))
    return [*out, now] if now else out


def powers(pieces: list[tuple[int, int, int]]):
    """Cut one part-filled window into sequences whose lengths are falling powers of two."""
    left = sum(p[2] for p in pieces)
    now, room = [], 1 << (left.bit_length() - 1)
    for d, start, length in pieces:
        while length:
            n = min(room, length)
            now.append((d, start, n))
            start, length, left, room = start + n, length - n, left - n, room - n
            if not room:
                yield now
                now, room = [], 1 << max(0, left.bit_length() - 1)


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end token alone. Repeated rows and null ids are documents of
    their own. Other columns are ignored; an empty table gives no rows. ``window`` is a power
    of two.
    """
    spark = docs.sparkSession
    tokens = cut(tokenized(docs, path, end_id), "packing-tokens")
    seen = frequencies(tokens).collect()  # bounded by the vocabulary
    n_docs = tokens.count()
    df = np.zeros(1 + max([end_id, *(r.token for r in seen)]), np.int64)
    for r in seen:
        df[r.token] = r.df
    stats = spark.sparkContext.broadcast((np.log1p((n_docs - df + 0.5) / (df + 0.5)), sum(r.n for r in seen) / max(1, n_docs)))

    def run(batches):
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 40, 0
        idf, mean = stats.value
        for rows in shards(batches):
            part = [np.frombuffer(x, "<u4") for _, x in rows]
            index = Index(part, idf, mean)
            out: list[list] = [[] for _ in PIECES]
            windows = filled([len(x) for x in part], lambda d: np.argsort(-index.scores(d), kind="stable").tolist(), window)
            last = windows.pop() if sum(p[2] for p in windows[-1]) < window else None
            for seq in (*windows, *(powers(last) if last else ())):
                at = 0
                for d, start, length in seq:
                    for column, v in zip(out, (rows[d][0], start, length, zlib.crc32(part[d][start : start + length].tobytes()), len(part[d]), base + n, at)):
                        column.append(v)
                    at += length
                n += 1
            yield as_batch(PIECES, *out)

    def shards(batches):
        """Rows of one index at a time, in the order of the lexical key: ``shard_docs`` documents or SHARD_BYTES of ids."""
        rows, size = [], 0
        for b in batches:
            for d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.append((d, i))
                size += len(i)
                if len(rows) >= shard_docs or size >= SHARD_BYTES:
                    yield rows
                    rows, size = [], 0
        if rows:
            yield rows

    # as many partitions as the session shuffles to, whatever the rows: each holds many shards, one after the other
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.repartitionByRange(max(1, min(most, -(-n_docs // shard_docs))), "shard_key", "tie", "doc_id").sortWithinPartitions("shard_key", "tie", "doc_id")
    return dealt.select("doc_id", "ids").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
