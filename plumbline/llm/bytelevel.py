"""Byte-level BPE by pre-tokens: the ids of a text, most of them by lookup.

The library's pre-token pattern starts a new pre-token at every space that
something other than white space follows, and looks at nothing before it. The
pieces of a text between such spaces are therefore encoded independently of
one another. Words repeat far more often than they are new, so a bounded cache
turns most of the encoding into dictionary lookups. What a batch of texts
misses goes to the library many pieces to a string, joined by the spaces that
come before them anyway: each token that begins with a space begins a piece.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: A worker keeps two halves of its cache, each of so many entries: the older goes as the newer is full. Longer pieces are never kept.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 64
#: Pieces that go to the library as one string.
JOINED = 200

# A worker has one core; threads of the library would take those of other tasks.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_wide = re.compile(r" \s").search
_starts = re.compile(r" (?=\S)").split


def is_byte_level(path: str) -> bool:
    """Whether a .json tokenizer is plain byte-level BPE, as this module splits it."""
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    pre = config.get("pre_tokenizer") or {}
    added = config.get("added_tokens") or []
    return (
        pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and config.get("normalizer") is None
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    )


def split(text: str) -> list[str]:
    """A text's first piece, then those after its spaces, without these spaces."""
    if text[-1:] == " " or _wide(text):
        return _starts(text)
    return text.split(" ")


class PieceTable:
    """What the library makes of pieces, remembered within bounds.

    ``cut(ids, at)`` gives the values of the runs of ``ids`` that start at
    ``at``, one value per run.
    """

    def __init__(self, path: str, cut, given: dict | None = None) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            special = [t["content"] for t in json.load(file).get("added_tokens") or []]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda text: None
        self.cut, self.given = cut, given or {}
        self.spaced = np.zeros(max(self.library.get_vocab(True).values(), default=0) + 1, bool)
        for token, i in self.library.get_vocab(True).items():
            self.spaced[i] = token.startswith("\u0120")  # the byte of a space, as byte-level vocabularies write it
        #: By piece: after a space (the newer and the older half), and without one.
        self.after, self.older, self.alone = dict(self.given), {}, {}

    def encode(self, pieces: list[str]) -> list:
        """The value of each piece by itself."""
        out: list = []
        for e in self.library.encode_batch_fast(pieces, add_special_tokens=False):
            out += self.cut(np.array(e.ids, np.int64), np.zeros(1, np.int64))
        return out

    def encode_after(self, pieces: list[str]) -> list:
        """The value of each piece after a space, many of them by one call."""
        out: list = []
        parts = [pieces[k : k + JOINED] for k in range(0, len(pieces), JOINED)]
        joined = [" " + " ".join(p) for p in parts]
        for part, text, e in zip(parts, joined, self.library.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, np.int64)
            at = np.flatnonzero(self.spaced[ids])
            # Pieces with spaces of their own (before white space), or a special string across two: one at a time.
            whole = len(at) == len(part) == text.count(" ") and not self.special(text)
            out += self.cut(ids, at) if whole else self.encode([f" {p}" for p in part])
        return out

    def texts(self, texts: list[str]) -> list[list]:
        """The values of each text's pieces in order. Texts with a special string are one piece."""
        parts = [[t] if self.special(t) else split(t) for t in texts]
        alone = self.alone
        firsts = list({p[0] for p in parts} - alone.keys())
        new = set().union(*(p[1:] for p in parts)).difference(self.after) if parts else set()
        if len(self.after) + len(new) > len(self.given) + CACHE_ENTRIES:
            self.older, self.after = self.after, dict(self.given)
            new = set().union(*(p[1:] for p in parts)).difference(self.after)
        after, older = self.after, self.older
        if older:
            known = new.intersection(older)
            new -= known
            after.update((p, older[p]) for p in known)
        if len(alone) + len(firsts) > CACHE_ENTRIES // 4:
            alone = self.alone = {}
            firsts = list({p[0] for p in parts})
        new = list(new)
        alone.update(zip(firsts, self.encode(firsts)))
        after.update(zip(new, self.encode_after(new)))
        out = [[alone[p[0]], *map(after.__getitem__, p[1:])] for p in parts]
        for held, own in ((alone, firsts), (after, new)):
            for p in own:
                if len(p) > CACHE_CHARS:
                    del held[p]
        return out
