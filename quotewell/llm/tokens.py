"""Whole-text encoding with the tokenizers library, fast on repeated words."""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

#: Words whose ids are remembered in a Python worker, and the longest word that is.
CACHE_WORDS, CACHE_CHARS = 250_000, 48
#: Plain letters are one pre-token; printable ASCII that follows them, and doesn't begin with a letter, is parted from them.
_PARTS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-@\\[-`{-~][!-~]{0,15})?").fullmatch


def _lower(text: str) -> str:
    """Lower-cased where that can't change ids: the tokenizer lower-cases too, but special tokens are found before."""
    if "<|" in text:
        return text
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


class WordEncoder:
    """Encodes a text as ``Tokenizer.encode`` does, word by word, with the ids of frequent words remembered.

    For tokenizers that drop white space and never merge across it (a pre-tokenizer that keeps only matches without white
    space, as in word_bpe_49k.json), the ids of a text are the ids of its pieces between spaces and line ends. New words of
    plain letters are encoded together and parted at their end-of-word tokens. The remembered words are dropped when they
    are ``CACHE_WORDS``.
    """

    _held: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.new: dict[str, bytes] = {"": b""}
        self.last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, bool)
        self.last[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; a null text has none."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The same for several texts, whose new words are encoded together."""
        split = [_lower(t).replace("\n", " ").split(" ") if t else [] for t in texts]
        new = self.new
        missing = set().union(*split).difference(new)
        extra = self._learn(list(missing)) if missing else None
        if extra:
            out = [b"".join([extra[w] if w in extra else new[w] for w in words]) for words in split]
        else:
            out = [b"".join(map(new.__getitem__, words)) for words in split]
        if len(new) > CACHE_WORDS:
            new.clear()
            new[""] = b""
        return out

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Remembers the ids of words; returns those of words too long to be remembered."""
        new, extra, odd = self.new, {}, []
        joined_of: dict[str, tuple[str, str]] = {}
        rest: dict[str, None] = {}
        for w in missing:
            parts = _PARTS(w)
            if parts is None:
                odd.append(w)
            elif parts[2]:  # what follows the letters is pre-tokenized by itself: few different ends, and each word once
                joined_of[w] = base, end = parts.groups()
                if base not in new:
                    rest[base] = None
                if end not in new:
                    new[end] = np.asarray(self._ids(end), "<u4").tobytes()
            else:
                rest[w] = None
        if rest:
            ids = np.asarray(self._ids(" ".join(rest)), "<u4")
            ends = np.flatnonzero(self.last[ids])
            if len(ends) != len(rest):
                raise ValueError("the tokenizer doesn't end each word with one end-of-word token")
            data, at = ids.tobytes(), 0
            for w, end in zip(rest, (4 * (ends + 1)).tolist(), strict=True):
                (new if len(w) <= CACHE_CHARS else extra)[w] = data[at:end]
                at = end
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            (new if len(w) <= CACHE_CHARS else extra)[w] = np.asarray(e.ids, "<u4").tobytes()
        for w, (base, end) in joined_of.items():
            (new if len(w) <= CACHE_CHARS else extra)[w] = (new[base] if base in new else extra[base]) + new[end]
        return extra

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
