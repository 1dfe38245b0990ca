"""Ids of the lower-casing word BPE, word by word, equal to what the tokenizers library gives for whole texts.

The library normalises a text (NFC, white space to one space, lower case), takes the strings of special tokens out,
and then splits it into pre-tokens no piece of the vocabulary crosses.  So the ids of a text are the ids of its
pre-tokens in order, and each distinct pre-token needs the merges only once.
"""

from __future__ import annotations

import re

import regex

from curata.llm.textmap import WordCodes, held

# Fixed values of the vocabulary file: its pre-token pattern, with white space as the library's engine has it.
_EXACT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
# The same for texts of the plain characters below, by the faster module.
_FAST = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
# Not plain: anything but ASCII without U+001C..1F, the Latin letters to U+024F whose lower case is one letter, and common dashes and quotes.
_ODD = re.compile("[^\x00-\x1b\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-įı-ɏ‐-‧]")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others for U+0100 and on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in own else chr(more))
        more += b not in own
    return out


class WordBpe:
    """Words and ids by one vocabulary file.

    A word is what white space delimits after normalising: the smallest unit found without a pattern.  It is cut into
    pre-tokens only when it is met first.
    """

    def __init__(self, path: str, most: int = 200_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.special_ids = {f" {t}": [i] for t, i in special.items()}  # no word holds a space
        self.letters = _byte_letters()
        self.codes = WordCodes(self._encode, most)

    def _encode(self, words: list[str]) -> list[list[int]]:
        merge, letters = self.tokenizer.model.tokenize, self.letters
        out = []
        for word in words:
            if word in self.special_ids:
                out.append(self.special_ids[word])
                continue
            ids: list[int] = []
            for pre in (_EXACT if _ODD.search(word) else _FAST).findall(word):
                ids += [t.id for t in merge(pre if pre.isascii() and pre.isprintable() else "".join([letters[b] for b in pre.encode()]))]
            out.append(ids)
        return out

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text, which no piece crosses; a special token's string is one, marked by a space before it."""
        if self.special and "<|" in text and self.special.search(text):
            out: list[str] = []
            for k, part in enumerate(self.special.split(text)):
                out += [f" {part}"] if k % 2 else self._cut(part)
            return out
        return self._cut(text)

    def _cut(self, text: str) -> list[str]:
        return _EXACT.findall(self.tokenizer.normalizer.normalize_str(text)) if _ODD.search(text) else _FAST.findall(text.lower())

    def pieces(self, pre_token: str) -> int:
        """The number of pieces of a pre-token."""
        if pre_token in self.special_ids:
            return 1
        plain = pre_token.isascii() and pre_token.isprintable()
        return len(self.tokenizer.model.tokenize(pre_token if plain else "".join([self.letters[b] for b in pre_token.encode()])))

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token's string is one, marked by a space before it."""
        if self.special and "<|" in text and self.special.search(text):
            out: list[str] = []
            for k, part in enumerate(self.special.split(text)):
                out += [f" {part}"] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _ODD.search(text):
            return _EXACT.findall(self.tokenizer.normalizer.normalize_str(text))
        return text.lower().split()


def word_bpe(path: str) -> WordBpe:
    """The worker's tokenizer for a file."""
    return held(("word_bpe", path), lambda: WordBpe(path))
