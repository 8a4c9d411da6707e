"""Ids of words against the library, and what the cache of words keeps."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from heddle.llm.encoder import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "The", "été", "Ñandú", "Жук", "日本", "한글", "ǆ", "ʰx", "µ", "٣", "5", "1.5", "'s", "don't", "x's", "...", "##", "$", "<|endoftext|>", "a<|endoftext|>b", "|x", "é", " ", "\t", "\x1c", "\r\n", "\n", "\n\n", " ", "  ", ",", ".", "²", "😀", "٬", "½a"]


def ids(tok, text):
    return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_of_joined_bits():
    rng, tok = np.random.default_rng(5), Tokenizer.from_file(PATH)
    texts = ["".join(BITS[k] for k in rng.integers(0, len(BITS), rng.integers(1, 8))) for _ in range(4000)]
    texts += [" ".join(BITS[k].strip() or "x" for k in rng.integers(0, len(BITS), 8)) for _ in range(1000)]
    for enc in (Encoder(PATH), Encoder(PATH, most_bytes=2000)):
        assert enc.encode(texts) == [ids(tok, x) for x in texts]


def test_words_in_use_outlast_a_flood_of_others():
    """Words that come up again stay cached while others, each seen once, pass through a cache of a fixed size."""
    enc = Encoder(PATH, most_bytes=400_000)
    usual = [f"usual{chr(97 + k)}" for k in range(20)]
    other = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    for at in range(200):
        enc.encode([" ".join(["x", *usual])] if at % 4 == 0 else [" ".join(["x", *(f"once{other(200 * at + k)}" for k in range(200))])])
    enc.encode(["x " + " ".join(f"more{other(k)}" for k in range(200))])
    assert all(w in enc.words for w in usual)
    assert len(enc.words) < 4000


def test_a_line_break_makes_no_word_of_two():
    enc = Encoder(PATH)
    enc.encode(["one two.\nThree four", "Three\nfour"])
    assert "Three" not in enc.words and {"two.", "\nThree"} <= set(enc.words)
