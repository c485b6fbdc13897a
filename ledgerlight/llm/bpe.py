"""Byte-pair encoding and decoding as a bounded-lookahead streaming transducer.

The merge list fixes how many symbols past a point can still change the tokens before
it (``sufficient_lookahead``). Every word is therefore encoded through a window: tokens
that end further than that bound before the window's end are stable and are emitted, and
reading restarts at the last emitted boundary. Decoding is a state machine that takes
tokens one by one and holds back only an unfinished character. Of a text only a bounded
number of words, or of tokens of one long word, is held as tokens at a time.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import as_batch, keyed, small_batches

#: Entries that a process remembers; the memory is emptied when full, so it stays constant.
CACHE = 200_000
#: Symbols that a window holds besides the lookahead.
WINDOW = 512
#: Words, or tokens of a long word, that are held at a time; characters from which a word is long and is not remembered.
HELD, LONG = 4096, 64
#: Characters whose words are found at a time.
PART = 1 << 16
NEVER = 1 << 60
#: Unicode white space, as the public library's patterns take it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: Unicode 16 beside Python's own tables of 15.1, fixed values: ranges of new letters and of new numbers.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Capital letters of Unicode 16 and 17 (first, last, lower case of the first), fixed values.
NEW_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
#: Letters that Latin texts use most: they are told first.
COMMON = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u02af"


def ranges(codes: Iterable[int]) -> str:
    """A character class's content for sorted code points."""
    out: list[list[int]] = []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@cache
def character_class(kind: str, new: tuple[tuple[int, int], ...]) -> str:
    """The letters (L) or numbers (N) of Unicode 16 as a set of the ``regex`` module, whatever version that module knows."""
    own = {c for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind} | {c for a, b in new for c in range(a, b + 1)}
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    module = {ord(c) for c in regex.findall(rf"\p{{{kind}}}", every)}
    base = rf"[\p{{{kind}}}--[{more}]]" if (more := ranges(sorted(module - own))) else rf"\p{{{kind}}}"
    return (COMMON if kind == "L" else "0-9") + base + ranges(sorted(own - module))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Merges:
    """A merge list with its vocabulary: ranks, results and the lookahead they need."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab, self.rank = vocab, {}
        for i, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), i)
        self.lookahead = sufficient_lookahead(merges)

    def encode(self, symbols: list[str]) -> list[str]:
        """All merges, lowest rank first and leftmost at ties: short words by scanning, others with a heap, O(n log n)."""
        n, rank = len(symbols), self.rank.get
        if n < 24:
            sym = list(symbols)
            ranks = [rank(p, NEVER) for p in zip(sym, sym[1:])]
            while ranks and (low := min(ranks)) != NEVER:
                i = ranks.index(low)
                sym[i : i + 2] = [sym[i] + sym[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank((sym[i - 1], sym[i]), NEVER)
                if i < len(ranks):
                    ranks[i] = rank((sym[i], sym[i + 1]), NEVER)
            return sym
        sym, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if sym[i] == a else -1
            if j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], right[i] = a + b, "", right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (r := self.rank.get((sym[p], sym[q]))) is not None:
                    heapq.heappush(heap, (r, p, sym[p], sym[q]))
        return [s for s in sym if s]

    def stream(self, symbols: Iterable[str], window: int = WINDOW) -> Iterator[str]:
        """Tokens of a symbol stream; holds at most ``window`` plus lookahead symbols at a time."""
        it, held, most, ended = iter(symbols), [], window + self.lookahead, False
        sizes: list[int] = []
        while not ended or held:
            while not ended and len(held) < most:
                s = next(it, None)
                if s is None:
                    ended = True
                else:
                    held.append(s)
            tokens = self.encode(held)
            if ended:
                yield from tokens
                return
            sizes = spans(held, tokens)
            at = 0
            for t, size in zip(tokens, sizes):
                if at + size > len(held) - self.lookahead:
                    break
                yield t
                at += size
            if at == 0:
                most *= 2  # one token longer than the window: widen it, still bounded by the longest token
            del held[:at]


def spans(symbols: list[str], tokens: list[str]) -> list[int]:
    """How many symbols each token covers."""
    out, i = [], 0
    for t in tokens:
        n, k = 0, 0
        while n < len(t):
            n += len(symbols[i])
            i, k = i + 1, k + 1
        out.append(k)
    return out


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols past a boundary that can still decide whether it stays.

    Whether merge r = (u, v) applies at a place depends on v, which may lose its right
    part to an earlier merge (s, y) with s on v's right spine (v, its right part, the
    right part of that, ...), and so on from y with still earlier merges. Ranks fall along
    such a chain, so need[r] = len(v) + max(need[q] : q < r, left(q) on v's right spine)
    is well founded; the largest need bounds all chains.
    """
    made = {}
    for a, b in merges:
        made.setdefault(a + b, (a, b))
    by_left: dict[str, tuple[list[int], list[int]]] = {}  # ranks, and the largest need so far
    most, ends = 1, {}

    def spine(v: str) -> list[str]:
        if v not in ends:
            ends[v] = [v, *(spine(made[v][1]) if v in made else ())]
        return ends[v]

    width = lambda v: len(v.removesuffix("</w>")) or 1
    for r, (u, v) in enumerate(merges):
        need = 0
        for s in spine(v):
            if s in by_left:
                ranks, top = by_left[s]
                if k := bisect_left(ranks, r):
                    need = max(need, top[k - 1])
        need += width(v)
        ranks, top = by_left.setdefault(u, ([], []))
        ranks.append(r)
        top.append(max(need, top[-1] if top else 0))
        most = max(most, need)
    return most


class Decoder:
    """Byte-to-text state machine: push tokens one by one, get text as soon as characters are whole.

    Tokens of a byte-level vocabulary stand for bytes. A file without a decoder joins its
    tokens by blanks: the bytes of each token come after one, but for the first.
    """

    def __init__(self, byte_level: bool):
        self.byte = {c: bytes([i]) for i, c in enumerate(byte_alphabet())} if byte_level else None
        self.lead = b"" if byte_level else b" "
        self.state, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def push(self, token: str) -> str:
        raw = b"".join([self.byte.get(c) or c.encode() for c in token]) if self.byte else token.encode()
        raw, self.begun = (self.lead if self.begun else b"") + raw, True
        return self.state.decode(raw)

    def whole(self) -> bool:
        """Whether no part of a character is held back."""
        return not self.state.getstate()[0]

    def close(self) -> str:
        self.begun = False
        return self.state.decode(b"", True)


class Tokenizer:
    """A ``tokenizers`` JSON file of kind BPE: splits, normalises and encodes the way that library does.

    Supports the two public byte-level layouts: ``</w>`` word ends with NFC, white space
    and lower-case normalisers, and plain byte-level BPE.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = Merges(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.normal, self.byte_level = spec["normalizer"] is not None, spec["decoder"] is not None
        self.white = regex.compile(f"[{WHITE}]")
        self.latin, self.any = self._pattern(r"\p{L}", r"\p{N}"), None
        self.alphabet = byte_alphabet()
        self.known: dict[str, tuple[int, ...]] = {}

    def _pattern(self, letter: str, number: str):
        if self.normal:
            return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{WHITE}{letter}{number}]+", regex.V1)
        return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+", regex.V1)

    def words(self, text: str) -> Iterator[str]:
        """Words of normalised text, a part of it at a time; all tables agree on the characters of Latin-1."""
        try:
            text.encode("latin-1")
            pattern = self.latin
        except UnicodeEncodeError:
            if self.any is None:
                self.any = self._pattern(character_class("L", NEW_LETTERS), character_class("N", NEW_NUMBERS))
            pattern = self.any
        at = 0
        while self.normal and len(text) - at > PART and (cut := self.white.search(text, at + PART)):  # no word holds white space
            yield from pattern.findall(text, at, cut.start())
            at = cut.start()
        yield from pattern.findall(text, at)

    def pieces(self, text: str) -> Iterator[str | int]:
        """Words in order, and the id of each added token found verbatim."""
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                yield self.added[part]
            elif part:
                if self.normal:
                    part = part.lower() if part.isascii() else lowered(unicodedata.normalize("NFC", part))
                yield from self.words(part)

    def word_tokens(self, word: str) -> Iterator[str]:
        """Tokens of a word, by the transducer."""
        symbols = map(self.alphabet.__getitem__, word.encode("utf-8", "replace"))
        return self.merges.stream(ended(symbols, self.suffix) if self.suffix else symbols)

    def word_ids(self, word: str) -> tuple[int, ...]:
        if (got := self.known.get(word)) is None:
            got = tuple(map(self.merges.vocab.__getitem__, self.word_tokens(word)))
            if len(self.known) >= CACHE:
                self.known.clear()
            if len(word) <= LONG:
                self.known[word] = got
        return got

    def ids(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in ((p,) if p.__class__ is int else self.word_ids(p))]


def ended(symbols: Iterable[str], suffix: str) -> Iterator[str]:
    """The symbols, the last with a word's end."""
    last = None
    for s in symbols:
        if last is not None:
            yield last
        last = s
    if last is not None:
        yield last + suffix


CAPITALS = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in NEW_CAPITALS) + "]")


def _new_lower(m) -> str:
    c = ord(m[0])
    return next(chr(c - a + to) for a, b, to in NEW_CAPITALS if a <= c <= b)


def lowered(text: str) -> str:
    """Lower case character by character, without the rule for a final sigma, with capitals newer than Python's tables."""
    text = text.replace("Σ", "σ").lower()
    return CAPITALS.sub(_new_lower, text) if max(text, default="") >= chr(NEW_CAPITALS[0][0]) else text


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for each file and process."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


class Digester(dict):
    """word -> (number of ids, their decimal text, their decoded text), each begun as within a text; made once for each word."""

    def __init__(self, tok: Tokenizer):
        super().__init__()
        self.tok = tok
        self.names = {i: t for t, i in tok.merges.vocab.items()} | {i: t for t, i in tok.added.items()}
        self.decoder = Decoder(tok.byte_level)
        self.decoder.push("")

    def of(self, tokens: Iterable[int]):
        ids = list(tokens)
        return len(ids), "".join([f" {i}" for i in ids]), "".join([self.decoder.push(self.names[i]) for i in ids])

    def __missing__(self, word):
        got = self.of((word,) if word.__class__ is int else map(self.tok.merges.vocab.__getitem__, self.tok.word_tokens(word)))
        if len(self) >= CACHE:
            self.clear()
        assert self.decoder.whole()  # a word is whole characters: what it decodes to does not depend on what stood before
        self[word] = got
        return got

    def text(self, text: str) -> Iterator[list[tuple[int, str, str]]]:
        """A text's words, at most HELD of them at a time, or as many tokens of a long word."""
        held = []
        for p in self.tok.pieces(text):
            if p.__class__ is int or len(p) <= LONG:
                held.append(self[p])
            else:
                yield held
                held, ids = [], map(self.tok.merges.vocab.__getitem__, self.tok.word_tokens(p))
                while some := list(islice(ids, HELD)):
                    yield [self.of(some)]
            if len(held) >= HELD:
                yield held
                held = []
        yield held


ROUND_TRIP = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every whole text.

    A null or empty text has no tokens, the digests of the empty string. Repeated rows and
    null ids give one row each; other columns are ignored; an empty table gives no rows.
    A file without a decoder joins its tokens by spaces, as the public library does.
    """

    def run(batches):
        digest = Digester(tokenizer(path))
        skip = len(digest.decoder.lead)
        for b in small_batches(batches):
            counts, ids, texts = [], [], []
            for t in b.column(1).to_pylist():
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                for some in digest.text(t or ""):
                    one, two = "".join([g[1] for g in some]).encode(), "".join([g[2] for g in some]).encode()
                    of_ids.update(one if n else one[1:])  # nothing stands before the first
                    of_text.update(two if n else two[skip:])
                    n += sum([g[0] for g in some])
                counts.append(n)
                ids.append(of_ids.hexdigest())
                texts.append(of_text.hexdigest())
            yield as_batch(ROUND_TRIP, b.column(0), counts, ids, texts)

    return keyed(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
