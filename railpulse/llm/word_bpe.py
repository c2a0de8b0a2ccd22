"""Ids of a word-level BPE file of the tokenizers library, a word at a time.

The file's steps are: canonical composition, white space to one space, lower case, a split into words, merges.
Texts of characters below ``PLAIN_END`` are composed already and lower-case character by character; they are cut
at white space, which no step looks across, each distinct stretch is cut into words with one regular expression,
and each distinct word is merged by the library's model; a worker remembers the ids.  Any other text, and one that holds an added token, goes through the library whole.
Both ways read a long text in parts that end before white space.  A longer word is merged in segments.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers

from railpulse.llm.long_pieces import SEGMENT, encode_long

FILE = "word_bpe_49k.json"
PART_CHARS = 1 << 20  # characters of a text that are read at once
RECENT = 250_000  # words, and stretches between white space, whose ids a worker remembers in each of two generations
LONG_WORD = 64  # longer ones are not remembered
PLAIN_END = 0x180
_LETTERS = "".join(c for c in map(chr, range(PLAIN_END)) if c.isalpha())
_NUMBERS = "".join(c for c in map(chr, range(PLAIN_END)) if c.isnumeric())
_SPACE = "\t\n\v\f\r \x85\xa0"
# the separators 1C to 1F are white space to str.split, but not to the file
_NOT_PLAIN = re.compile(f"[^\x00-\x1b\x20-{chr(PLAIN_END - 1)}]")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}{_SPACE}]+")
_PART_END = re.compile("[ \t\n\v\f\r]")


class Recent(dict):
    """Values of ``make``, remembered; when ``most`` are held, those not asked for since the last time go."""

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest
        self.before: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class WordCodec:
    """Encoder over one tokenizer file; one in each Python worker."""

    def __init__(self, content: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers
        self.whole = Tokenizer.from_str(content)
        self.model = self.whole.model
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spec = json.loads(content)
        self.added = [t["content"] for t in spec["added_tokens"]]
        # the model without word ends, for segments of a word that are not its last
        self.inner = functools.cache(lambda: models.BPE(
            vocab=spec["model"]["vocab"], merges=[tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]))
        self.words = Recent(self.word, RECENT, LONG_WORD)
        self.stretches = Recent(self.stretch, RECENT, LONG_WORD)

    def word(self, word: str) -> bytes:
        """Ids (little-endian 32-bit) of one word."""
        if not (word.isascii() and word.isprintable()):
            word = self.bytes_of.pre_tokenize_str(word)[0][0]  # one character for each byte
        if len(word) <= SEGMENT:
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

        def part(data: bytes, last: bool) -> tuple[np.ndarray, np.ndarray]:
            got = (self.model if last else self.inner()).tokenize(data.decode("utf-32-le"))
            return np.array([t.id for t in got], "<u4"), np.array([4 * (t.offsets[1] - t.offsets[0]) for t in got])

        return encode_long(word.encode("utf-32-le"), part, 4 * SEGMENT).tobytes()

    def stretch(self, text: str) -> bytes:
        """Ids of lower-case text without white space."""
        return b"".join(map(self.words.__getitem__, _WORDS.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids (little-endian 32-bit) of ``text``, without special tokens put round it."""
        plain = not _NOT_PLAIN.search(text) and not any(a in text for a in self.added)
        out, begin = [], 0
        while begin < len(text):
            end = begin + PART_CHARS
            if end < len(text):
                at = _PART_END.search(text, end)
                end = at.start() if at else len(text)
            part = text[begin:end]
            if plain:
                out.append(b"".join(map(self.stretches.__getitem__, part.lower().split())))
            else:
                out.append(np.array(self.whole.encode(part, add_special_tokens=False).ids, "<u4").tobytes())
            begin = end
        return b"".join(out)


@functools.cache
def word_codec(content: str) -> WordCodec:
    return WordCodec(content)


def file_content(path: str | None = None) -> str:
    with open(path or public_tokenizers.path(FILE), encoding="utf-8") as f:
        return f.read()
