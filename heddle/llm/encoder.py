"""Exact token ids at bulk speed: each distinct word goes through the tokenizers library once, as long as a cache holds it.

The byte-level pre-tokenizer splits a text with a fixed pattern before any merge. Some places are a split whatever stands around
them: before a space between two non-space characters, on both sides of a lone line break, and between a letter and punctuation. A text
cut there, encoded in words and joined gives the ids of the whole text. Texts with other white space are encoded whole. Tokenizers with
a normalizer, a post-processor that changes ids or another pre-tokenizer are always encoded whole.
"""

from __future__ import annotations

import codecs
import os
import re
import sys
from array import array
from operator import attrgetter

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np

from .caches import use

#: Letters in any version of Unicode that the library may follow; a word with others is encoded by its pre-tokenizer.
_LETTERS = "[A-Za-zªµºÀ-ÖØ-öø-ɏΆΈ-ΊΌΎ-ΡΣ-ϵЀ-ҁҊ-ԣぁ-ゖァ-ヺ一-龥가-힣]+"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The ids of an array are little-endian unsigned 32-bit integers as they are.
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4
_ENCODERS: dict[str, Encoder] = {}
_id = attrgetter("id")


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    use("encoder", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Words(dict):
    """Word to ids, None where it cannot be encoded apart; its entries come to about `most_bytes` at most.

    Words that came up again stay. New ones fill a quarter of the room, and as much again holds those before them, which are let go if
    they do not come up. When the words that stay fill their half, they start over as words that may come up.
    """

    def __init__(self, ids_of, most_bytes: int):
        super().__init__()
        self.ids_of, self.most_bytes = ids_of, most_bytes
        self.old: dict[str, bytes | None] = {}
        self.new: list[str] = []
        self.kept_bytes = self.new_bytes = 0

    def __missing__(self, word: str) -> bytes | None:
        size = 150 + 2 * len(word)
        if word in self.old:
            self[word] = ids = self.old[word]
            self.kept_bytes += size
            if self.kept_bytes > self.most_bytes // 2:
                for w in self.new:
                    del self[w]
                self.old, self.new, self.kept_bytes, self.new_bytes = self.copy(), [], 0, 0
                self.clear()
            return ids
        ids = self.ids_of(word)
        self.new_bytes += size
        if self.new_bytes > self.most_bytes // 4:
            self.old, self.new, self.new_bytes = {w: self.pop(w) for w in self.new}, [], size
        self.new.append(word)
        self[word] = ids
        return ids


class Encoder:
    """ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most_bytes: int = 64 << 20):
        self.sp = None
        if path.endswith(".model"):
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added, letters = list(self.tok.get_added_tokens_decoder().values()), _byte_letters()
        marks = "".join(c for c in _PUNCTUATION if not any(c in x.content for x in added))  # a cut within an added token would undo it
        self.fast = self.tok.normalizer is None and repr(self.tok.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)" and not any(x.lstrip or x.rstrip or x.single_word or re.search(rf"\s|^{_LETTERS}$", x.content) for x in added)
        self.fast = self.fast and bool(marks) and type(self.tok.model).__name__ == "BPE" and all(self.tok.model.token_to_id(c) is not None for c in letters)
        if self.fast:
            self.tokenize, self.letters, self.space = self.tok.model.tokenize, "".join(letters), letters[ord(" ")]
            self.shape = re.compile(rf"({_LETTERS})([{re.escape(marks)}].*)?", re.DOTALL).fullmatch
            self.line_break = self._whole(["\n"])[0]
            self.fast = len(self.line_break) == 4
            self.words, self.tails = _Words(self._word, most_bytes), _Words(lambda x: self._whole([x])[0], most_bytes // 8)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text, null as empty."""
        texts = [x or "" for x in texts]
        if self.sp is not None:
            return [np.array(x, dtype="<u4").tobytes() for x in self.sp.encode(texts, num_threads=1)]
        if not self.fast:
            return self._whole(texts)
        out, get, whole = [b""] * len(texts), self.words.__getitem__, []
        for i, x in enumerate(texts):
            if x:
                try:  # every word after a space or a line break, which the first one is given and loses again
                    out[i] = b"".join(map(get, ("\n" + x).replace("\n", " \n").split(" ")[1:]))[4:]
                except TypeError:  # white space that is no lone space or line break
                    whole.append(i)
        for i, x in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = x
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _together(self, word: str) -> bytes:
        """Of letters alone, or a space and letters: what the pre-tokenizer keeps together."""
        ids = array("I", map(_id, self.tokenize(codecs.charmap_decode(word.encode(), "strict", self.letters)[0])))
        return ids.tobytes() if _NATIVE else np.array(ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes | None:
        """Of a word with the space or line break before it; a space is not written. None where white space at an end may make no split."""
        if _NATIVE and word.isascii() and word.isalpha():  # letters that stand for themselves
            return array("I", map(_id, self.tokenize(self.space + word))).tobytes()
        space, before = (" ", b"") if word[:1] != "\n" else ("", self.line_break)
        word = word if space else word[1:]
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        shape = self.shape(word)
        if not shape:
            return before + self._whole([space + word])[0]
        first, tail = shape.groups()
        if not tail:
            return before + self._together(space + first)
        return before + (self.words[first] if space else self._together(first)) + self.tails[tail]
