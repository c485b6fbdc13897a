"""The transducer's tokenizer against the public library: every code point, long words, and decoding."""

import random

import pytest
from test_contracts import library

from ledgerlight.llm import registry
from ledgerlight.llm.bpe import Decoder, Digester, byte_alphabet, tokenizer

NAME = "word_bpe_49k.json"


def test_every_code_point():
    lib, own = library(NAME), tokenizer(registry.vocabulary_file(NAME))
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{c}b {c} " for c in every[at : at + 64]) for at in range(0, len(every), 64)]
    wrong = [hex(64 * k) for k, (t, e) in enumerate(zip(texts, lib.encode_batch(texts, add_special_tokens=False))) if own.ids(t) != e.ids]
    assert not wrong, wrong[:20]


def plain(tok, text):
    """Count, ids and decoded text as ``round_trip`` digests them."""
    d = Digester(tok)
    got = [g for some in d.text(text) for g in some]
    return sum(g[0] for g in got), "".join(g[1] for g in got)[1:], "".join(g[2] for g in got)[len(d.decoder.lead) :]


@pytest.mark.parametrize("name", [NAME, "byte_bpe_50k.json"])
def test_long_words_and_decoding(name):
    rnd = random.Random(2)
    lib, own = library(name), tokenizer(registry.vocabulary_file(name))
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäß語и") for _ in range(n))
    texts = ["", " ", "a" * 30_000, word(20_000), "!" * 5000, "Σίσυφος ΑΣ ΣΑΣ", "it's we'll’s  x　y", "é <|endoftext|> z", "0123456789" * 30, " ".join(word(rnd.randint(1, 90)) for _ in range(9000)), "퟿\U0001f600 \U00016ea0Ɤ"]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert plain(own, t) == (len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False)), t[:40]


def test_decoder_holds_back_only_unfinished_characters():
    letters, d = byte_alphabet(), Decoder(True)
    raw = "aé語😀".encode()
    out = [d.push(letters[b]) for b in raw]
    assert "".join(out) + d.close() == "aé語😀" and out[0] == "a" and out[1:3] == ["", "é"]
    assert d.push(letters[0xE8]) == "" and not d.whole() and d.close() == "�"
