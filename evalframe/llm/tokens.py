"""Token ids of whole texts with a tokenizer file of the ``tokenizers`` library.

The vocabulary in use drops white space, treats each white-space separated word by itself
and lower-cases, so a text's ids are those of its words, one after the other.  Each Python
worker keeps the ids of the words it has met lately (at most ``limit`` words and those of
one text) and asks the library for the others only.  Most words of a corpus are met once or
twice, so a larger store takes memory and hardly saves time.
"""

from __future__ import annotations

import functools
import os
import re
import string
import struct
import unicodedata

from evalframe.llm.shared import kept

LIMIT = 1 << 18
# ASCII punctuation but for the end of a special token
TAIL = string.punctuation.replace(">", "").encode()


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes stand
    for themselves, the others for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in plain else next(rest) for b in range(256)}


BYTE_LETTERS = byte_letters()
# letters up to U+00FF (already composed) -> the letters of the bytes of their lower case
LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
LETTER_BYTES = {c: "".join(chr(BYTE_LETTERS[b]) for b in chr(c).lower().encode())
                for c in range(256) if LETTERS(chr(c))}


@functools.cache
def ends_word(c: str) -> bool:
    """Whether a character is still a letter or digit at its end once composed and lowered."""
    return unicodedata.normalize("NFC", c).lower()[-1].isalnum()


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """UTF-8 word -> its ids as little-endian unsigned 32-bit integers.

    Once half of ``limit`` words are new, they become ``old`` and those old before go; an old
    word that is met again is new again, so frequent words stay."""

    def __init__(self, path: str, limit: int = LIMIT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library, self.limit = Tokenizer.from_file(path), limit
        self.model = self.library.model
        self.four = {i: packed([i]) for i in self.library.get_vocab().values()}
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.old[word]
        return ids

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text (only ASCII white space separates words here)."""
        # A-Z can be lowered beforehand unless a special token may be spelled out or a
        # combining mark (U+0300-036F: lead bytes CC, CD) may compose with the letter
        if b"<|" not in text and (text.isascii() or not (b"\xcc" in text or b"\xcd" in text)):
            text = text.lower()
        words = text.split()
        ids = list(map(self.get, words))  # one look-up a word, the rest only for those not kept
        at = [i for i, x in enumerate(ids) if x is None]
        if at:
            self.learn([words[i] for i in at])
            for i in at:
                ids[i] = self[words[i]]
        return b"".join(ids)

    def learn(self, words: list[bytes]) -> None:
        if len(self) > self.limit // 2:
            self.old = dict(self)
            self.clear()
        old, tokenize, four = self.old, self.model.tokenize, self.four
        cut, rest = [], {}
        for w in set(words):
            if w in old:
                self[w] = old[w]
            if w in self:
                continue
            core = w.rstrip(TAIL)
            # punctuation after a letter or digit is a piece of text of its own
            if core != w and core and (core.isalpha() or ends_word(core.decode("utf-8", "replace")[-1])):
                tail = w[len(core):]
                if tail not in self and tail not in old:
                    rest[tail] = tail.decode()
                cut.append((w, core, tail))
                if core in self or core in old:
                    continue
            else:
                core = w
            text = core.decode("utf-8", "replace")
            if LETTERS(text):
                if not text.isascii():
                    text = text.translate(LETTER_BYTES)
                self[core] = b"".join([four[t.id] for t in tokenize(text)])
            else:
                rest[core] = text
        if rest:
            for c, e in zip(rest, self.library.encode_batch_fast(list(rest.values()), add_special_tokens=False)):
                self[c] = packed(e.ids)
        for w, core, tail in cut:
            self[w] = self[core] + self[tail]


def encoder(path: str) -> WordIds:
    """The worker's encoder of a tokenizer file."""
    return kept(path, lambda: WordIds(path))
