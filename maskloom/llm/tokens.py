"""Token ids of whole texts by a public tokenizer file, with a word cache per worker."""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import numpy as np

#: Words kept per worker; the cache is emptied when it is full (about 70 MB).
CACHE_WORDS = 400_000
#: Characters for which Python's case rules and classes are the tokenizer's own.
PLAIN = "\t\n\r\x20-\x7e\xa0-įı-ſ"


def _class(kind: str) -> str:
    chars = (chr(c) for c in range(0xA0, 0x180) if unicodedata.category(chr(c))[0] == kind)
    return ("a-z" if kind == "L" else "0-9") + "".join(chars)


_NOT_PLAIN = re.compile(f"[^{PLAIN}]")
_WORD = re.compile(f"[{_class('L')}]+|[{_class('N')}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_class('L')}{_class('N')}]+")


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer lowers a text, cuts it into words and merges within words only, so a word's ids
    are kept and looked up. Texts with characters outside ``PLAIN`` or with ``<|`` (which may open a
    special token) go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(1 + max(vocabulary.values()), bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 256):
            found = self.tokenizer.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)
            out.extend(np.asarray(x.ids, dtype="<u4").tobytes() for x in found)
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word; they are encoded as one text, and cut after the ids that end a word."""
        [found] = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.asarray(found.ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        data, starts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(starts, starts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if "<|" in t or _NOT_PLAIN.search(t) else _WORD.findall(t.lower()) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = [w for w in set().union(*filter(None, cut)) if w not in known]
        for i in range(0, len(new), 4096):
            known.update(zip(new[i : i + 4096], self._words(new[i : i + 4096]), strict=True))
        return [
            self._whole([t])[0] if words is None else b"".join(map(known.__getitem__, words))
            for t, words in zip(texts, cut, strict=True)
        ]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and tokenizer file."""
    return WordEncoder(path)
