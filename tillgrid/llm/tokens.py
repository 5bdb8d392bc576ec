"""Token ids of whole texts, by the ``tokenizers`` library.

The two tokenizers used here cut a text into parts (runs of letters, digits,
other signs) before anything else, so a text's ids are the ids of its parts in
order. Parts repeat far more than texts do: ``PartEncoder`` asks the library once
per distinct part and keeps the answer in a bounded dictionary. It cuts into
parts only texts of Latin letters, ASCII signs, blanks and line ends; of other
texts it takes the white-space-delimited units, and a text with other white
space, control characters or the string of an added token is encoded whole.
"""

from __future__ import annotations

import re
from array import array

#: Parts kept per generation of the dictionary; two generations at most are
#: held (about 150 MB a worker).
CACHE_PARTS = 400_000
#: Longer parts are encoded each time: they hardly repeat and would fill the memory.
CACHE_CHARS = 64
#: Texts encoded together.
BATCH = 400

#: White space and controls other than blank and line end.
ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0 ᠎ -‏ -  -⁯　﻿]")
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ž"
#: Parts the model can take as they are: one run of letters, digits or other ASCII signs, a blank before it at most.
PART = re.compile(f" ?(?:[{LETTERS}]+|[0-9]+|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\\[-`{{-~]+)")
#: Texts that are cut into parts.
PLAIN = re.compile(f"[\n\x20-\x7e{LETTERS}]*")
#: Parts, and the white-space-delimited units of other texts. In the byte-level
#: form ("spaced") a single blank belongs to what follows it; in the form with
#: word ends ("words") white space is dropped and letters are lower-cased.
PARTS = {
    "spaced": f" ?[{LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^ \n0-9{LETTERS}]+|[ \n]+(?![^ \n])|[ \n]",
    "words": f"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \n0-9{LETTERS}]+",
}
#: The same for ASCII texts, which are cut faster by it.
ASCII_PARTS = {form: p.replace(LETTERS, "A-Za-z") for form, p in PARTS.items()}
UNITS = {"spaced": r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]", "words": r"[^ \n]+"}


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one letter: printable Latin-1 as itself, the others as the letters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class PartEncoder(dict):
    """Text -> little-endian unsigned 32-bit ids. The dictionary maps part -> ids.

    When it is full it becomes the old generation, from which parts still in use
    are taken over.
    """

    _loaded: dict[tuple[str, str], PartEncoder] = {}

    def __init__(self, path: str, form: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        # Strings of added tokens are taken out of a text before it is cut: a text that may hold one is encoded whole.
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.I).search if added else None
        self.fold = str.lower if form == "words" else str
        self.parts, self.ascii_parts, self.units = (re.compile(x[form]).findall for x in (PARTS, ASCII_PARTS, UNITS))
        self.model, self.letters = self.tok.model, _byte_letters()
        self.old: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, form: str) -> PartEncoder:
        """One encoder per Python worker, file and form ("words" or "spaced")."""
        if (path, form) not in cls._loaded:
            cls._loaded[path, form] = cls(path, form)
        return cls._loaded[path, form]

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None and PART.fullmatch(part):
            # Already cut and folded: the library's model alone, on the part's bytes as letters.
            letters = part.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        elif ids is None:
            ids = self.whole(part)
        if len(part) <= CACHE_CHARS:
            if len(self) >= CACHE_PARTS:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def _cut(self, text: str) -> list[str]:
        if self.added and self.added(text):
            return [text]
        if PLAIN.fullmatch(text):
            return (self.ascii_parts if text.isascii() else self.parts)(self.fold(text))
        if ODD.search(text):
            return [text]
        out: list[str] = []
        for unit in self.units(text):
            out += self.parts(self.fold(unit)) if PLAIN.fullmatch(unit) else [unit]
        return out

    def encode(self, texts: list[str], end_id: int):
        """Ids of all ``texts`` one after the other, each with ``end_id`` after it, and how many each has."""
        import numpy as np
        end = array("I", [end_id]).tobytes()
        ids = [b"".join(map(self.__getitem__, self._cut(t))) + end for t in texts]
        return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
