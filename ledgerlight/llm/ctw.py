"""Code lengths of texts by context-tree weighting over bytes, and by word frequencies beside it.

A byte is eight binary decisions. For each decision there is a tree of contexts of the last
0, 1, ... ``DEPTH`` bytes; each node estimates by Krichevsky and Trofimov from the zeros and
ones it has seen, and weighs its own estimate against that of its children. The corpus is
counted once, the trees are weighed from the leaves up and read from the root down; texts
are then scored by the finished trees, those learned from as well.

Nothing of the size of the corpus is held in one place. Texts are dealt into blocks of some
megabytes. A block asks for each different context and byte (and word) of its own once; what
the model answers is met with the block's texts again, so that a very frequent context costs
one row a block and not one row an occurrence.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_batch, cut, keyed, release, small_batches

#: Bytes of context, at most 6: a context and a byte are one number.
DEPTH = 4
#: Bytes of text in a block, one text more or less; longer texts are a block of their own.
BLOCK = 32 << 20
#: Documents learned from: all but those with this remainder of the check sum of their id.
PARTS, HELD_OUT = 7, 2
TEXTS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.binary())])
ASKED = pa.schema([("block", pa.int64()), ("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SQL_SCORED = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double"


def blocks(docs: DataFrame) -> DataFrame:
    """Whole texts, null as empty, each with the block it is dealt to: the task and a number within it."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % PARTS == HELD_OUT, F.lit(False))

    def run(batches):
        block, size = TaskContext.get().partitionId() << 32, 0
        for b in small_batches(batches):
            if size + b.nbytes > BLOCK and size:
                block, size = block + 1, 0
            size += b.nbytes
            yield as_batch(TEXTS, [block] * b.num_rows, b.column(0), b.column(1), b.column(2))

    whole = docs.select("doc_id", held.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return whole.mapInArrow(run, "block long, doc_id long, held_out boolean, text binary")


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte of every place of every text as one number, the end of a text as byte 0 and what lies before it as zeros; and where each text ends."""
    raw = b"\0" * 8 + (b"\0" * depth).join([*texts, b""])
    ends = np.cumsum([len(t) + depth for t in texts])
    every = np.ndarray((len(raw) - 8,), ">u8", raw, offset=1, strides=(1,)).astype(np.uint64) & np.uint64((1 << 8 * (depth + 1)) - 1)
    if depth > 1:  # the end of a text is its first zero
        keep = np.ones(len(every), bool)
        keep[(ends[:, None] - np.arange(1, depth)).ravel()] = False
        every = every[keep]
        ends = ends - (depth - 1) * np.arange(1, len(texts) + 1)
    return every.view(np.int64), ends


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def lower_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return text.lower().split()


class Asked:
    """What one block asks for: contexts with a byte, and words, with their counts in the texts learned from."""

    def __init__(self, depth: int):
        self.depth, self.grams, self.words = depth, [], Counter()

    def add(self, texts: list[bytes], held: list[bool]) -> None:
        for learn in (True, False):
            some = [t for t, h in zip(texts, held) if h != learn]
            if some:
                keys, n = counted(grams(some, self.depth)[0])
                self.grams.append((keys, n if learn else np.zeros_like(n)))
                for t in some:
                    if learn:
                        self.words.update(lower_words(t))
                    else:
                        self.words.update(dict.fromkeys(lower_words(t), 0))
        if len(self.grams) > 8:
            self.grams = [self.merged()]

    def merged(self):
        return summed(*(np.concatenate(x) for x in zip(*self.grams)))

    def rows(self, block: int):
        keys, n = self.merged()
        for at in range(0, len(keys), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield as_batch(ASKED, np.full(len(keys[part]), block), keys[part], pa.nulls(len(keys[part]), pa.binary()), n[part])
        words = list(self.words.items())
        for at in range(0, len(words), 1 << 16):
            w, n = zip(*words[at : at + (1 << 16)])
            yield as_batch(ASKED, np.full(len(w), block), pa.nulls(len(w), pa.int64()), w, n)


def asked(texts: DataFrame, depth: int) -> DataFrame:
    """(block, gram or word, n): everything different in each block, with its count in the texts learned from."""

    def run(batches):
        block, got = None, None
        for b in small_batches(batches):
            names = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
            text, held = b.column(3).to_pylist(), b.column(2).to_pylist()
            for lo, hi in zip(edges, edges[1:]):
                if lo < hi:
                    if names[lo] != block:
                        if got:
                            yield from got.rows(block)
                        block, got = int(names[lo]), Asked(depth)
                    got.add(text[lo:hi], held[lo:hi])
        if got:
            yield from got.rows(block)

    return texts.mapInArrow(run, "block long, gram long, word binary, n long")


def log_gamma(x: Column) -> Column:
    """Stirling's series, eight places above ``x``."""
    y = x + 8
    near = x
    for k in range(1, 8):
        near = near * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(near)


def log_kt(zeros: Column, ones: Column) -> Column:
    """Log probability that Krichevsky and Trofimov give to so many zeros and ones."""
    return F.when(zeros + ones == 0, 0.0).otherwise(log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi))


def decisions(gram: DataFrame) -> DataFrame:
    """The eight decisions of each context and byte: ``node`` is the context with a 1 and the bits before, ``bit`` what follows."""
    one = lambda k: F.expr(f"struct((gram - (gram & 255)) | {1 << k}L | shiftright(gram & 255, {8 - k}) AS node, shiftright(gram, {7 - k}) & 1 AS bit)")
    return gram.select("*", F.inline(F.array(*map(one, range(8)))))


def weighed(gram: DataFrame, depth: int) -> list[DataFrame]:
    """The tables of nodes for contexts of 0 to ``depth`` bytes: zeros, ones, and the node's log odds of its own estimate against its children's."""
    counts = decisions(gram).groupBy("node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("ones"))
    levels = [cut(counts.withColumn("weight", log_kt(F.col("zeros"), F.col("ones"))), f"ctw-{depth}")]
    for d in range(depth - 1, -1, -1):
        up = levels[-1].groupBy(F.expr(f"node & {(1 << 8 * (d + 1)) - 1}L").alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weight").alias("below"))
        own = up.withColumn("own", log_kt(F.col("zeros"), F.col("ones")))
        both = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - math.log(2)
        levels.append(cut(own.select("node", "zeros", "ones", both.alias("weight"), (F.col("own") - F.col("below")).alias("odds")), f"ctw-{d}"))
    return levels[::-1]


def model(gram: DataFrame, depth: int) -> DataFrame:
    """(gram, value): log10 probability of the byte after its context, for every context and byte of the corpus.

    From the root down each node adds its estimate with the weight that is left to it; where
    nothing was learned its odds are even and its estimate a half, which needs no case of its own.
    Tables of nodes are merged: their files are much smaller than their rows, and a plan that
    goes by files would send millions of rows through the driver.
    """
    levels = weighed(gram, depth)
    kt = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    above = None
    for d, level in enumerate(levels):
        own = 1 / (1 + F.exp(-F.col("odds"))) if d < depth else F.lit(1.0)
        if above is None:
            above = level.select("node", (own * kt).alias("seen"), (1 - own).alias("left"))
        else:
            joined = level.withColumn("parent", F.expr(f"node & {(1 << 8 * d) - 1}L")).join(above.withColumnRenamed("node", "parent").hint("merge"), "parent")
            above = joined.select("node", (F.col("seen") + F.col("left") * own * kt).alias("seen"), (F.col("left") * (1 - own)).alias("left"))
    one = F.least(F.greatest(F.col("seen"), F.lit(1e-300)), F.lit(1 - 2.0**-52))
    log = F.log10(F.when(F.col("bit") == 1, one).otherwise(1 - one))
    return decisions(gram.select("gram")).join(above.hint("merge"), "node").groupBy("gram").agg(F.sum(log).alias("value"))


def spread(texts: pa.Table, answers: pa.Table, depth: int, tokens: int, distinct: int, ends: int):
    """Scores of a block's texts from the answers to what it asked."""
    gram = answers.column("gram")
    known = gram.is_valid()
    one = answers.filter(known)
    keys, values = one.column("gram").to_numpy(), one.column("value").to_numpy()
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    other = answers.filter(pa.compute.invert(known))
    count = dict(zip(other.column("word").to_pylist(), other.column("value").to_pylist()))
    log = lambda c: math.log10((c + 1) / (tokens + 1 * (distinct + 1)))
    base = {w: log(c) for w, c in count.items()}
    end = log(ends)
    for b in small_batches(texts.to_batches()):
        text = b.column("text").to_pylist()
        places, till = grams(text, depth)
        value = values[np.searchsorted(keys, places)]
        score = np.add.reduceat(value, np.concatenate(([0], till[:-1])))
        words = [lower_words(t) for t in text]
        yield as_batch(
            SCORED, b.column("doc_id"), b.column("held_out"), list(map(len, text)), [len(w) + 1 for w in words], [sum(count[x] > 0 for x in w) + (ends > 0) for w in words],
            [math.fsum(map(base.__getitem__, w)) + end for w in words], score,
        )


def scores(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probability of every whole text by context-tree weighting (``score``) and by word frequencies (``base_score``).

    Learned from the documents that are not ``held_out``: those whose decimal id has another
    check sum than ``HELD_OUT`` mod ``PARTS``; a null id is learned from. A text's code ends
    with its end, as byte 0, so that a null or empty text has the score of the end alone
    (and one token). Repeated rows count and are scored each; other columns are ignored,
    whatever their names; an empty table gives no rows. Without a text learned from every
    bit costs a half. Texts of any length are scored whole; one longer than ``BLOCK`` is a
    block of its own. More columns: n_bytes, n_tokens, n_known, train_tokens, and
    ``bits_per_byte``, the code length for each byte and the end.
    """
    texts = cut(blocks(keyed(docs, id_col, text_col)), "ctw-texts")
    asks = cut(asked(texts, depth), "ctw-asked")
    words = cut(asks.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "ctw-words")
    gram = cut(asks.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")), "ctw-grams")
    ends = texts.where("NOT held_out").count()
    n, v = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = n + ends, v + (ends > 0)
    probability = cut(model(gram, depth), "ctw-model")
    release(gram)
    answers = (
        asks.where("gram IS NOT NULL").select("block", "gram").join(probability.hint("merge"), "gram").select("block", "gram", F.lit(None).cast("binary").alias("word"), "value")
        .unionByName(asks.where("word IS NOT NULL").select("block", "word").join(words.hint("merge"), "word").select("block", F.lit(None).cast("long").alias("gram"), "word", F.col("n").cast("double").alias("value")))
    )

    def run(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.Table.from_batches(spread(texts, answers, depth, tokens, distinct, ends), SCORED)

    got = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SQL_SCORED)
    bits = -F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)
    return got.withColumn("train_tokens", F.lit(tokens).cast("long")).withColumn("bits_per_byte", bits)
