"""Token ids by the tokenizers library, with a per-worker memory of what single pre-tokens become.

A text whose characters are all below U+0100 is cut into pre-tokens here: in that range letters, digits
and white space are fixed, so the cut is the tokenizer's own. Each new pre-token is encoded once by the
library's model. Any other text, and one that holds the string of a special token, goes through the library
whole. Both give the same ids.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

from tokenizers import Tokenizer

# Letters, numbers and white space below U+0100, and the two tokenizers' patterns.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r \x85\xa0"
BYTE_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_ENDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")

#: Pre-tokens remembered by a worker before it starts anew, and the longest of them: about 200 MB.
REMEMBERED, LONGEST = 1_000_000, 64
#: Characters of a long text that the library is given at a time.
CHUNK = 100_000
#: Where a text can be cut without changing a pre-token: before a blank between two characters that are none.
SEAM = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write a character below U+0100: one letter for each of its UTF-8 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class Known(dict):
    """Pre-token to ids; a new one is encoded when it is first asked for."""

    def __init__(self, model, code: str) -> None:
        self.tokenize, self.letters, self.code = model.tokenize, byte_letters(), code

    def __missing__(self, part: str) -> bytes:
        ids = array(self.code, [x.id for x in self.tokenize(part.translate(self.letters))]).tobytes()
        if len(part) <= LONGEST:
            self[part] = ids
        return ids


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Parts of a text, cut at the first seam after each `size` characters; without a seam the rest is one part."""
    at = 0
    while at < len(text):
        seam = SEAM.search(text, at + size) if len(text) > at + size else None
        end = seam.start() if seam else len(text)
        yield text[at:end]
        at = end


class Encoder:
    def __init__(self, path: str, lower: bool, code: str = "I") -> None:
        """lower: the vocabulary of lower-case words with word ends; else the byte-level one. code: array code of an id."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.code, self.lower = code, lower
        self.cut = (WORD_ENDS if lower else BYTE_LEVEL).findall
        self.known = Known(self.whole.model, code)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as unsigned integers in the machine's (little-endian) order; none for null."""
        if not text:
            return b""
        if any(t in text for t in self.special):
            return self.by_library([text])
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.by_library(chunks(text))
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        parts = self.cut(text.lower() if self.lower else text)
        return b"".join(map(known.__getitem__, parts))

    def by_library(self, parts: Iterable[str]) -> bytes:
        return b"".join(array(self.code, self.whole.encode(t, add_special_tokens=False).ids).tobytes() for t in parts)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, lower: bool, code: str = "I") -> Encoder:
    """One for each worker process."""
    key = (path, lower, code)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
