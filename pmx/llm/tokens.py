"""Token ids by the tokenizers library, with the ids of single words kept.

Neither vocabulary merges across the white space between words, so the ids of a text are
those of its words, and a word seen before needs no encoding again. Words new
to a block are encoded by the library: those of Latin letters with signs behind go straight to its
model, letters and signs apart as both vocabularies part them, all others through its whole chain in one batch. Only
single spaces and line ends are taken for borders of words: a text with other or repeated white space goes to the library whole, and so does one that holds the name of a special token.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import islice

#: Words known to a worker at most (some 200 bytes each); beyond, only those learnt first stay, which holds the frequent ones.
KEEP, STAY = 1_000_000, 200_000
#: Latin letters, composed and with one lower case each, then signs; no apostrophe, for what follows one may belong to it.
_PLAIN = re.compile(r"(\0?)([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
#: The sign that stands for a byte in byte-level vocabularies: its own where it is printable, else the next from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SIGN_OF = {b: b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)}


class Words:
    """Encoder to little-endian uint16 ids (both vocabularies have fewer than 65,536)."""

    def __init__(self, path: str, spaced: bool, keep: int = KEEP, special: bool = True):
        """``spaced``: a word's ids depend on a space before it (byte-level); else white space leaves no ids.

        ``special``: the name of a special token in a text (``<|endoftext|>``) becomes its id, as the library has it; else it is text as any other.
        """
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = not special
        self.names = [x.content.casefold() for x in self.t.get_added_tokens_decoder().values()] if special else []
        if self.t.get_vocab_size() >= 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.spaced, self.keep, self.known, self.model = spaced, keep, {}, self.t.model

    def raw(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str] | None:
        """Words; where spaces count, the first of a line is marked by a zero and line ends are pieces. None: the library has to see the text whole."""
        if any(x in text.casefold() for x in self.names):
            return None
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        return None if "\0" in text else ("\0" + text.replace("\n", " \n \0")).split(" ")

    def _plain(self, word: str) -> bytes | None:
        """The ids of a word that is letters, then signs; None if it is not."""
        m = _PLAIN.fullmatch(word)
        if not m or m[1] and not self.spaced:
            return None
        front, out = self.spaced and not m[1], []
        for part in m.group(2, 3):
            if part:
                part = part if self.spaced else part.lower()
                if not part.isascii():
                    part = part.encode().decode("latin-1").translate(_SIGN_OF)
                out += [x.id for x in self.model.tokenize("Ġ" + part if front else part)]
                front = False
        return array("H", out).tobytes()

    def _learn(self, words: list[str]) -> None:
        known, odd = self.known, []
        if self.spaced:
            known["\n"] = self.raw(["\n"])[0]
        for w in words:
            if self.spaced and not w.strip("\0"):
                known[w] = None  # no word, so its text needs the library
            elif (ids := self._plain(w)) is not None:
                known[w] = ids
            elif self.spaced and re.search(r"\s", w):
                known.setdefault(w, None)  # the same, but for the line end
            else:
                odd.append(w)
        plain = [w[1:] if w[0] == "\0" else " " + w for w in odd] if self.spaced else odd
        known.update(zip(odd, self.raw(plain), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self.known) > self.keep:
            self.known = dict(islice(self.known.items(), STAY))
        pieces = [self._pieces(t) if t else [] for t in texts]
        new = set().union(*(p for p in pieces if p)).difference(self.known)
        if new:
            self._learn(list(new))
        get, out, odd = self.known.__getitem__, [], []
        for i, p in enumerate(pieces):
            try:
                out.append(b"".join(map(get, p)))
            except TypeError:  # no list of words, or a word without ids of its own
                out.append(None)
                odd.append(i)
        for i, ids in zip(odd, self.raw([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        return out


_open: dict[tuple[str, bool], Words] = {}


def encoder(path: str, spaced: bool, keep: int = KEEP) -> Words:
    """One encoder a worker process; the first use sets how many words it keeps."""
    if (path, spaced) not in _open:
        _open[path, spaced] = Words(path, spaced, keep)
    return _open[path, spaced]
