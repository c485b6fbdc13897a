"""Suffix dedup of long repeats with run-length indexes.

Every string of ``length`` bytes holds one anchor, the place of its least hashed gram, and
equal strings hold equal anchors. So an anchor's surroundings are all that can match, and
equal strings meet under the anchor's hash. Whole surroundings that are copies of earlier
ones, by a digest of 128 bits, are collapsed where they arise. The different surroundings
of one anchor go to shards of bounded size; each shard builds a run-length index and
streams its own strings through it. Of equal strings the earliest stays; the others are
marked. Anchors with very many different surroundings, such as those in a line that a
third of all texts hold, are found before by mergeable counters of bounded size; their
strings are told by digests of 128 bits each and never meet in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_batch, cut, free_name, keyed, release, small_batches
from .runindex import RunIndex
from .shingles import U, mixed, powers

LENGTH, GRAM = 100, 32
#: Bytes of text whose copies are collapsed before they are sent.
COLLAPSE = 32 << 20
#: Symbols of an index on average; different surroundings of one anchor in an index at most.
SHARD, MOST = 1 << 18, 8_000
#: Counters of the search for crowded anchors: every anchor with more than one of HOT anchors is found.
COUNTERS, HOT = 4096, 2000
#: Rows of an anchor that a large batch need not count: far fewer than a crowded anchor has there.
FEW = 8
#: Ids below this are taken by rows without one.
NO_ID = -(1 << 63)
#: Second base of the digests, odd.
SECOND = U(0xD1342543DE82EF95)


def _spread(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over all windows of ``width`` values."""
    span = 1
    n = len(x) - width + 1
    while span * 2 <= width:
        x = f(x[:-span], x[span:])
        span *= 2
    return f(x[:n], x[width - span : width - span + n])


def _sums(raw: np.ndarray, base: np.ndarray) -> np.ndarray:
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * base[: len(raw)], out=total[1:])
    return total


_seconds: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def second_powers(n: int) -> list[np.ndarray]:
    """Powers of the second base and of its inverse."""
    if len(_seconds[0]) < n:
        for k, f in enumerate((SECOND, U(pow(int(SECOND), -1, 1 << 64)))):
            p = np.full(n, f, U)
            p[0] = 1
            _seconds[k] = np.multiply.accumulate(p)
    return [p[:n] for p in _seconds]


def anchors(texts: list[bytes], length: int, gram: int, both: bool = True):
    """(text, offset, hash of the gram, two digests of the surroundings) of all anchors of texts of ``length`` bytes or more; without ``both`` the second digest is 0."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    up, down = powers(n + 1)
    total = _sums(raw, up)
    h = mixed((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    width = length - gram + 1
    least = _spread(h, width, np.minimum)
    cross = np.ones(n - length + 1, bool)  # windows that cross a text's end
    for e, m in zip(ends.tolist(), lengths.tolist()):
        cross[max(0, e - m) : max(0, e - length + 1)] = False
    least[cross] = 0
    pad = np.zeros(width - 1, U)
    chosen = np.flatnonzero(_spread(np.concatenate((pad, least, pad)), width, np.maximum) == h)
    text = np.searchsorted(ends, chosen, "right")
    lo = np.maximum(chosen + gram - length, ends[text] - lengths[text])
    hi = np.minimum(chosen + length, ends[text])
    shape = (hi - lo).astype(U) * U(0x632BE59BD9B4E019) + (chosen - lo).astype(U)
    digest = lambda total, down: mixed((total[hi] - total[lo]) * down[lo] + shape).view(np.int64)
    one, two = digest(total, down), np.zeros(len(chosen), np.int64)
    if both:
        up, down = second_powers(n + 1)
        two = digest(_sums(raw, up), down)
    return text, chosen - (ends[text] - lengths[text]), h[chosen].view(np.int64), one, two


def _batches_of_anchors(batches, length: int, gram: int):
    """Columns (anchor, digest, second digest, id, tie, at) of about COLLAPSE bytes of texts (id, tie, text) at a time, equal surroundings together, and which rows are the first of theirs.

    Texts are taken in order of their keys, so that a stable sort by one mixed key leaves
    the earliest of equal surroundings first.
    """

    def ordered(held):
        held.sort(key=lambda r: r[:2])
        parts, at, size = [], 0, 0
        for k, r in enumerate(held):
            size += len(r[2])
            if size > 1 << 20 or k + 1 == len(held):
                own = held[at : k + 1]
                text, offset, a, d, e = anchors([x[2] for x in own], length, gram)
                ids, ties = (np.array([x[c] for x in own], np.int64)[text] for c in (0, 1))
                parts.append((a, d, e, ids, ties, offset))
                at, size = k + 1, 0
        a, d, e, i, t, at = (np.concatenate([p[k] for p in parts]) for k in range(6))
        order = np.argsort(mixed(a.view(U) * U(31) + d.view(U)), kind="stable")
        a, d, e, i, t, at = (x[order] for x in (a, d, e, i, t, at))
        return (a, d, e, i, t, at), np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (e[1:] != e[:-1])))[: len(a)]

    held, size = [], 0
    for b in small_batches(batches, 1 << 20):
        held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x or b"" for x in pc.cast(b.column(2), pa.binary()).to_pylist()))
        size += b.nbytes
        if size > COLLAPSE:
            yield ordered(held)
            held, size = [], 0
    if held:
        yield ordered(held)


def _pairs_of_anchors(batches, length: int, gram: int):
    """(anchor, digest of the surroundings) of about COLLAPSE bytes of texts (id, tie, text) at a time."""
    held, size = [], 0
    for b in small_batches(batches, 1 << 20):
        held.append(anchors([x or b"" for x in pc.cast(b.column(2), pa.binary()).to_pylist()], length, gram, both=False)[2:4])
        size += b.nbytes
        if size > COLLAPSE:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


class Counters:
    """Largest counts of a stream with a bounded number of counters, short by one of COUNTERS of the stream at most; sums of such are such."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        keys, at = np.unique(np.concatenate((self.keys, keys)), return_inverse=True)
        n = np.bincount(at, np.concatenate((self.n, n)), len(keys)).astype(np.int64)
        if len(keys) > COUNTERS:
            n -= np.partition(n, len(n) - COUNTERS - 1)[len(n) - COUNTERS - 1]
            keys, n = keys[n > 0], n[n > 0]
        self.keys, self.n = keys, n


def crowded(texts: DataFrame, length: int, gram: int, most: int) -> np.ndarray:
    """Anchors with more than one of HOT of all different surroundings, and ``most`` at least; not more than COUNTERS of them."""
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64()), ("total", pa.int64())])

    def run(batches):
        c, total = Counters(), 0
        for a, d in _pairs_of_anchors(batches, length, gram):
            total += len(a)
            own = np.sort(a)
            head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))[: len(own)]
            often = own[head][np.diff(np.append(head, len(own))) > (FEW if len(own) > FEW * 4 * HOT else 0)]
            rows = np.isin(a, often)
            a, d = a[rows], d[rows]
            order = np.lexsort((d, a))
            a, d = a[order], d[order]
            c.add(*np.unique(a[np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])))[: len(a)]], return_counts=True))
        yield as_batch(schema, np.append(c.keys, 0), np.append(c.n, 0), np.append(np.zeros(len(c.keys), np.int64), total))

    counted = cut(texts.mapInArrow(run, "anchor long, n long, total long").groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "counters")
    bound = F.greatest(F.lit(most), F.lit((counted.agg(F.sum("total")).first()[0] or 0) * (1 / HOT - 1 / COUNTERS)))
    got = counted.where(F.col("n") > bound).select("anchor").collect()  # COUNTERS at most: their sum is no larger than the total
    release(counted)
    return np.array(sorted(r.anchor for r in got), np.int64)


#: size 0: to be looked up; above 0: a stretch that copies an earlier one; -1: to be compared string by string.
SENT = pa.schema([("anchor", pa.int64()), ("around", pa.int64()), ("second", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])
SENT_COLUMNS = "anchor long, around long, second long, id long, tie long, at int, size int"


def _sent(texts: DataFrame, length: int, gram: int, hot: np.ndarray) -> DataFrame:
    """One row for each anchor; of copies met together only the earliest is to be looked up, the others are joined to stretches."""

    def run(batches):
        for (a, d, e, i, t, at), new in _batches_of_anchors(batches, length, gram):
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            marks = (i != i[first]) | (t != t[first]) | (at != at[first])
            mi, mt, ma, ms = merged(i[marks], t[marks], np.maximum(0, at[marks] + gram - length), at[marks] + length)
            size = np.where(np.isin(a[new], hot), -1, 0)
            anywhere = lambda i, t, at: mixed(i.view(U) * U(31) + t.view(U) * U(37) + at.astype(np.int64).view(U)).view(np.int64)
            yield as_batch(SENT, *(x[new] for x in (a, d, e, i, t, at)), size)
            zero = np.zeros(len(mi), np.int64)
            yield as_batch(SENT, anywhere(mi, mt, ma), zero, zero, mi, mt, ma, ms)  # these need not meet

    return texts.mapInArrow(run, SENT_COLUMNS)


#: kind 0: a stretch that copies an earlier one; 1: an anchor whose surroundings differ from others of it; 2: as 1, of a crowded anchor.
FOUND = pa.schema([("kind", pa.int32()), ("anchor", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])
FOUND_COLUMNS = "kind int, anchor long, id long, tie long, at int, size int"


def _dealt(rows: DataFrame, most: int, length: int, gram: int) -> DataFrame:
    """SENT rows, those of an anchor together and in order -> FOUND, in one pass; holds the different surroundings of one anchor, ``most`` of them at most."""

    def heads(held, kind):
        i, t, at = zip(*held)
        return np.full(len(held), kind), i, t, at

    def run(batches):
        anchor, last, first = None, None, None  # of the group that goes on: anchor, digests, (id, tie, at) of its first row
        held: list[tuple[int, int, int]] = []
        many = False
        for b in batches:
            size = b.column(6).to_numpy()
            done = np.flatnonzero(size != 0)
            if len(done):
                x = b.take(pa.array(done))
                hot = size[done] < 0
                yield as_batch(FOUND, np.where(hot, 2, 0), x.column(0), x.column(3), x.column(4), x.column(5), np.maximum(size[done], 0))
                b = b.take(pa.array(np.flatnonzero(size == 0)))
            if not b.num_rows:
                continue
            a, d, e, i, t, at = (b.column(k).to_numpy() for k in range(6))
            new = np.concatenate(([last != (a[0], d[0], e[0])], (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (e[1:] != e[:-1])))
            head, place = np.flatnonzero(new), np.cumsum(new) - 1  # place -1: goes on from the last batch
            own = [np.where(place < 0, first[k] if first else 0, x[head][place] if len(head) else 0) for k, x in enumerate((i, t, at))]
            copy = np.flatnonzero(~new & ((i != own[0]) | (t != own[1]) | (at != own[2])))
            begin = np.maximum(0, at[copy] + gram - length)  # a text's beginning cuts surroundings short
            out = [(np.zeros(len(copy)), a[copy], i[copy], t[copy], begin, at[copy] + length - begin)]

            def tell(held, kind, key):
                if held:
                    k, *place = heads(held, kind)
                    out.append((k, np.full(len(held), key), *place, np.zeros(len(held))))

            if len(head):
                ha, hi, ht, hp = a[head], i[head], t[head], at[head]
                edge = np.flatnonzero(np.concatenate(([True], ha[1:] != ha[:-1], [True])))
                # anchors that begin or end within the batch one by one; of those between, the ones with one head are done
                for g in sorted({0, len(edge) - 2} | set(np.flatnonzero(np.diff(edge) > 1).tolist())):
                    lo, hi_ = edge[g], edge[g + 1]
                    rows = list(zip(hi[lo:hi_].tolist(), ht[lo:hi_].tolist(), hp[lo:hi_].tolist()))
                    if anchor is not None and ha[lo] == anchor:
                        held += rows
                    else:
                        if many or len(held) > 1:
                            tell(held, 2 if many else 1, anchor)
                        held, many, anchor = rows, False, int(ha[lo])
                    if len(held) > most or many:
                        tell(held, 2, anchor)
                        held, many = [], True
                anchor, first = int(a[-1]), (int(hi[-1]), int(ht[-1]), int(hp[-1]))
            last = int(a[-1]), int(d[-1]), int(e[-1])
            yield as_batch(FOUND, *(np.concatenate([np.asarray(o[k]) for o in out]).astype(np.int64) for k in range(6)))
        if held and (many or len(held) > 1):
            k, i, t, at = heads(held, 2 if many else 1)
            yield as_batch(FOUND, k, np.full(len(held), anchor), i, t, at, np.zeros(len(held), np.int64))

    return rows.mapInArrow(run, FOUND_COLUMNS)


AROUND = pa.schema([("kind", pa.int32()), ("anchor", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("at", pa.int32()), ("bytes", pa.binary())])


def _around(texts: DataFrame, places: DataFrame, length: int, gram: int) -> DataFrame:
    """The surroundings of the places (kind, anchor, id, tie, at) as bytes; ``at``: where they begin."""

    def run(batches):
        for b in small_batches(batches, 1 << 20):
            rows: list[list] = [[] for _ in AROUND]
            for t, did, tie, own in zip(pc.cast(b.column(2), pa.binary()).to_pylist(), b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                for p in own:
                    lo = max(0, p["at"] + gram - length)
                    for c, v in zip(rows, (p["kind"], p["anchor"], did, tie, lo, t[lo : p["at"] + length])):
                        c.append(v)
            yield as_batch(AROUND, *rows)

    grouped = places.groupBy("id", "tie").agg(F.collect_list(F.struct("kind", "anchor", "at")).alias("places"))  # of one text's anchors
    return texts.join(grouped, ["id", "tie"]).select("id", "tie", "text", "places").mapInArrow(run, "kind int, anchor long, id long, tie long, at int, bytes binary")


MARKED = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])
MARKED_COLUMNS = "id long, tie long, at int, size int"


def merged(ids: np.ndarray, tie: np.ndarray, at: np.ndarray, end: np.ndarray):
    """(id, tie, at, size): touching or overlapping stretches of one text as one."""
    order = np.lexsort((at, tie, ids))
    ids, tie, at, end = ids[order], tie[order], at[order].astype(np.int64), end[order].astype(np.int64)
    if not len(ids):
        return ids, tie, at, end
    text = np.cumsum(np.concatenate(([0], (ids[1:] != ids[:-1]) | (tie[1:] != tie[:-1]))).astype(np.int64)) * (1 << 42)
    reach = np.maximum.accumulate(text + end)
    head = np.flatnonzero(np.concatenate(([True], text[1:] + at[1:] > reach[:-1])))
    last = np.concatenate((head[1:] - 1, [len(ids) - 1]))
    return ids[head], tie[head], at[head], reach[last] - text[head] - at[head]


def _indexed(around: DataFrame, length: int, shard: int) -> DataFrame:
    """Stretches that the shards' indexes tell to be copies of earlier strings."""

    def marks(rows):
        _, ids, tie, at, texts = rows
        group, k, start = RunIndex(texts, length).stream()
        ids, tie, at = np.array(ids, np.int64)[k], np.array(tie, np.int64)[k], np.array(at, np.int64)[k] + start
        order = np.lexsort((at, tie, ids, group))
        group, ids, tie, at = group[order], ids[order], tie[order], at[order]
        first = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), np.arange(len(group)), 0)) if len(group) else group
        again = np.flatnonzero((ids != ids[first]) | (tie != tie[first]) | (at != at[first]))
        return as_batch(MARKED, *merged(ids[again], tie[again], at[again], at[again] + length))

    def run(batches):
        rows: list[list] = [[] for _ in range(5)]
        size, last = 0, None
        for b in batches:
            for x in zip(*(b.column(k).to_pylist() for k in range(5))):
                if x[0] != last and size >= shard:
                    yield marks(rows)
                    rows, size = [[] for _ in range(5)], 0
                last = x[0]
                size += len(x[4]) + 1
                for c, v in zip(rows, x):
                    c.append(v)
        if rows[0]:
            yield marks(rows)

    parted = around.select("anchor", "id", "tie", "at", "bytes").repartition("anchor").sortWithinPartitions("anchor", "id", "tie", "at")
    return parted.mapInArrow(run, MARKED_COLUMNS)


def _strings(around: DataFrame, length: int) -> DataFrame:
    """The exact way for crowded anchors: each string by its digest, the earliest found by a sum."""
    schema = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("at", pa.int32())])

    def run(batches):
        for b in small_batches(batches, 1 << 18):
            texts = b.column(3).to_pylist()
            raw = np.frombuffer(b"".join(texts), np.uint8)
            sizes = np.array([len(t) for t in texts], np.int64)
            count = np.maximum(0, sizes - length + 1)
            text = np.repeat(np.arange(len(texts)), count)
            start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            lo = (np.cumsum(sizes) - sizes)[text] + start
            digests = []
            for up, down in (powers(len(raw) + 1), second_powers(len(raw) + 1)):
                total = _sums(raw, up)
                digests.append(mixed((total[lo + length] - total[lo]) * down[lo]).view(np.int64))
            yield as_batch(schema, *digests, b.column(0).to_numpy()[text], b.column(1).to_numpy()[text], b.column(2).to_numpy()[text] + start)

    every = around.select("id", "tie", "at", "bytes").mapInArrow(run, "one long, two long, id long, tie long, at int")
    first = cut(every.groupBy("one", "two").agg(F.min(F.struct("id", "tie", "at")).alias("first"), F.count("*").alias("n")).where("n > 1"), "strings")
    here = F.struct("id", "tie", "at")
    return every.join(first, ["one", "two"]).where(here != F.col("first")).select("id", "tie", "at", F.lit(length).alias("size"))


def marked(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, shard: int = SHARD) -> DataFrame:
    """(id, tie, at, size) stretches to remove from ``texts`` (id, tie, text); they may overlap and pass a text's end."""
    sent = _sent(texts, length, gram, crowded(texts, length, gram, most))
    dealt = sent.repartition("anchor").sortWithinPartitions("anchor", "around", "second", "id", "tie", "at")
    found = cut(_dealt(dealt, most, length, gram), "anchors")
    copies = found.where("kind = 0").select("id", "tie", "at", "size")
    around = cut(_around(texts, found.where("kind > 0"), length, gram), "around")
    out = copies.unionByName(cut(_indexed(around.where("kind = 1"), length, shard), "marks"))
    many = around.where("kind = 2")
    if not many.isEmpty():
        out = out.unionByName(cut(_strings(many, length), "marks"))
    release(around)
    return out


SPANS = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("spans", pa.list_(pa.int32()))])


def per_text(marks: DataFrame) -> DataFrame:
    """(id, tie, spans): all stretches of one text as one row, merged, as ends that alternate: begin, end, begin, end, ..."""

    def rows(ids, tie, at, size):
        head = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (tie[1:] != tie[:-1]))))[: len(ids)]
        ends = np.stack((at, at + size), 1).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(ids)) * 2, pa.int32()), pa.array(ends, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(tie[head]), lists], schema=SPANS)

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4  # of the text that may go on
        for b in batches:
            if b.num_rows:
                i, t, at, size = (np.concatenate((h, b.column(k).to_numpy().astype(np.int64))) for k, h in enumerate(held))
                i, t, at, size = merged(i, t, at, at + size)
                last = int(np.argmax((i == i[-1]) & (t == t[-1])))
                if last:
                    yield rows(i[:last], t[:last], at[:last], size[:last])
                held = [x[last:] for x in (i, t, at, size)]
        if len(held[0]):
            yield rows(*held)

    return marks.repartition("id", "tie").sortWithinPartitions("id", "tie", "at").mapInArrow(run, "id long, tie long, spans array<int>")


def spans(ends: list[int], text: bytes) -> list[tuple[int, int]]:
    """Stretches of ``text`` to remove, from a row of ``per_text``; the last one may pass its end."""
    return [(lo, min(hi, len(text))) for lo, hi in zip(ends[::2], ends[1::2]) if lo < len(text)]


def with_spans(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with one more column ``out``: the stretches to remove, or null.

    A null text is empty. Rows without an id come before all others; among rows with one
    id, or without, equal texts are one document and others follow in an order of their
    own, the same in every run: a digest of 64 bits of the text, taken only where an id
    stands more than once. Other columns are untouched. An empty table gives no rows.
    """
    id_, tie = free_name(docs, "_repeat_id"), free_name(docs, "_repeat_tie")
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    again = not docs.groupBy(own.alias("id")).count().where("count > 1").isEmpty()
    ties: Column = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) if again else F.lit(0).cast("long")
    texts = docs.select(own.alias("id"), ties.alias("tie"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if again:
        texts = texts.dropDuplicates(["id", "tie"])
    each = per_text(marked(texts, **how)).select(F.col("id").alias(id_), F.col("tie").alias(tie), F.col("spans").alias(out))
    return docs.withColumn(id_, own).withColumn(tie, ties).join(each, [id_, tie], "left").select(*docs.columns, out)


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _kept(text: bytes, cutouts: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in cutouts:
        parts.append(text[at:lo])
        at = hi
    return b"".join([*parts, text[at:]])


def digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; see ``with_spans``."""

    def run(batches):
        for b in small_batches(batches):
            rows: list[list] = [[] for _ in DIGESTS]
            for did, t, places in zip(b.column(0).to_pylist(), pc.cast(b.column(1), pa.binary()).to_pylist(), b.column(2).to_pylist()):
                t = t or b""
                s = spans(places or [], t)
                kept = _kept(t, s)
                for c, v in zip(rows, (did, len(t), len(t) - len(kept), len(s), hashlib.sha256(kept).hexdigest())):
                    c.append(v)
            yield as_batch(DIGESTS, *rows)

    return with_spans(keyed(docs), "_repeats", **how).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without the repeats in their texts; bytes that no longer make a character are dropped."""
    names = docs.columns
    found = with_spans(docs, free_name(docs, "_repeats"), id_col, text_col, **how)
    k = names.index(text_col)

    def run(batches):
        for b in small_batches(batches):
            texts = [
                None if t is None else _kept(t, spans(places, t)).decode("utf-8", "ignore") if places else t.decode("utf-8", "replace")
                for t, places in zip(pc.cast(b.column(k), pa.binary()).to_pylist(), b.column(len(names)).to_pylist())
            ]
            columns = [*b.columns[:k], pa.array(texts, b.schema.field(k).type), *b.columns[k + 1 : len(names)]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(run, docs.schema)
