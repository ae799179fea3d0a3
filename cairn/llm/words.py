"""Splitting text for the lower-casing word-end BPE vocabulary.

White space never takes part in a token there, so a text's tokens are those of
its white-space-delimited chunks, one after another.  Chunks repeat far more
often than texts do; every worker keeps what a chunk gave in a bounded table.

Words are handled in the vocabulary's byte letters.  A chunk of ASCII and the
letters of Latin-1, where all tables of characters agree, is cut by the fixed pattern
below; any other goes through the vocabulary's own normaliser and pre-tokenizer,
whose tables are newer than Python's.
"""

from __future__ import annotations

import json
import re

import public_tokenizers

VOCABULARY = "word_bpe_49k.json"
#: Characters of a chunk that a table keeps.
KEEP = 64

# The vocabulary's special strings, white space and pre-tokenizer pattern.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_PLAIN = re.compile("[\x00-\x7f\xc0-\xff]+")
_PLAIN_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\t-\r a-z0-9\xdf-\xf6\xf8-\xff]+")
#: Bytes whose letter is not their own character, in order; the letters follow from 256 on.
_UNPRINTED = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_LETTERS = {b: chr(256 + i) for i, b in enumerate(_UNPRINTED)}
_SPECIAL_SPLIT = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
_SPACES = re.compile("[" + SPACE + "]+")
#: str.split() also cuts at these, the vocabulary's white space does not hold them.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def chunks(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return [x for x in _SPACES.split(text) if x]
    return text.split()


def special_parts(chunk: str) -> list[str]:
    """The chunk cut around special strings, which stand at odd places."""
    return _SPECIAL_SPLIT.split(chunk) if "<|" in chunk else [chunk]


class ChunkTable(dict):
    """What every chunk gives, filled as chunks come and emptied beyond ``limit`` bytes.

    Chunks and words of more than ``KEEP`` characters are not kept.  ``word`` gives the value of a pre-token in byte letters, ``total`` sums up a
    chunk's values, and ``special`` holds those of the special strings.  Words
    of other letters than a to z are kept in a second table.
    """

    def __init__(self, path: str, word, total, special: dict, limit: int):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.word, self.total, self.special, self.limit = word, total, special, limit
        self.words: dict = {}
        self.held = 0

    def _counted(self, key: str) -> bool:
        """Whether to keep a chunk or word; the bytes count strings and values at their largest."""
        if len(key) > KEEP:
            return False
        self.held += 200 + 20 * len(key)
        if self.held > self.limit:
            self.clear()
            self.words.clear()
            self.held = 0
        return True

    def __missing__(self, chunk: str):
        if chunk.isascii() and chunk.isalpha() and chunk.islower():
            value = self.word(chunk)
        else:
            value = self.total(self._parts(chunk))
        if self._counted(chunk):
            self[chunk] = value
        return value

    def _word(self, letters: str):
        if letters.isascii() and letters.isalpha():  # a chunk of its own
            return self[letters]
        value = self.words.get(letters)
        if value is None:
            value = self.word(letters)
            if self._counted(letters):
                self.words[letters] = value
        return value

    def _parts(self, chunk: str) -> list:
        found = []
        for at, part in enumerate(special_parts(chunk)):
            if at % 2:
                found.append(self.special[part])
            else:
                found += map(self._word, self._pieces(part))
        return found

    def _pieces(self, part: str) -> list[str]:
        """Pre-tokens of a chunk without special strings, in byte letters."""
        if _PLAIN.fullmatch(part):
            found = _PLAIN_PIECE.findall(part.lower())
            return [p if p.isascii() and p.isprintable() else p.encode("utf-8").decode("latin-1").translate(_LETTERS) for p in found]
        return [letters for letters, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))]


def load_merges(path: str) -> dict[tuple[str, str], int]:
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    return {tuple(m.split(" ") if isinstance(m, str) else m): rank for rank, m in enumerate(merges)}
