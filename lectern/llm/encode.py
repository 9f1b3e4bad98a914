"""Exact and fast encoding with the vocabulary files of public tokenizers.

A text is cut where no token can cross, each piece is encoded once and kept, so common words cost a dictionary look-up.
The result equals ``Tokenizer.encode(text, add_special_tokens=False).ids``; texts that the shortcuts don't cover, such as those
that spell a special token, go to that call as they are.
"""

from __future__ import annotations

import gc
import os
import re
import struct

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries kept per worker; beyond it those go that were not asked for since half of them came. Only memory depends on it.
KEPT = 600_000

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: White space other than blank and line feed: there the cuts below aren't safe.
_ODD_SPACE = re.compile("[\t\x0b\f\r\x1c-\x1f\x85\xa0  -​    　﻿]")
_SPACED = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_PLAIN = re.compile(rf"[ \n!-~{_LATIN}]*\Z")
_BYTE_RULE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LATIN}]+| ?[0-9]+| ?[^ \n{_LATIN}0-9]+|[ \n]+(?![^ \n])|[ \n]+")
_WORD_RULE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LATIN}]+|[0-9]|[^ \n{_LATIN}0-9]+")


def _byte_alphabet() -> dict[int, int]:
    """Printable stand-ins of the 256 bytes, as byte-level vocabularies spell them."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 0x100 + i for i, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()
_BLANK = chr(_ALPHABET[0x20])


class _Units(dict):
    """unit -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, model):
        self.model, self.old = model, {}

    def __missing__(self, unit: str) -> bytes:
        if (out := self.old.get(unit)) is None:
            out = self._spell(unit)
        if len(self) >= KEPT // 2:
            self.old = dict(self)
            self.clear()
        if len(unit) <= 64:
            self[unit] = out
        return out

    def _spell(self, unit: str) -> bytes:
        spelled = unit[1:] if unit[0] == " " else unit
        if not (spelled.isascii() and spelled.isprintable() and " " not in spelled):
            spelled = unit.encode().decode("latin-1").translate(_ALPHABET)
        elif spelled is not unit:
            spelled = _BLANK + spelled
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)


def whole(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Encoder:
    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        splits = spec.get("pre_tokenizer") or {}
        model = spec["model"]
        safe = model["type"] == "BPE" and not model.get("dropout") and all(t.get("special") for t in spec.get("added_tokens", []))
        byte = safe and spec.get("normalizer") is None and splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
        word = safe and [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits.get("pretokenizers", [])] == ["Split", "ByteLevel"]
        #: A text with an added token's spelling, in whatever case, isn't cut.
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", []) if t["content"]]
        self.special = re.compile("|".join(added), re.I).search if added else lambda text: None
        self.rule, self.fold = (_BYTE_RULE if byte else _WORD_RULE if word else None), bool(word)
        #: Cuts that no token crosses, as long as white space is blanks and line feeds.
        self.cut = _SPACED.findall if byte else str.split
        self.units = _Units(self.tokenizer.model)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if self.rule is None or _ODD_SPACE.search(text) or self.special(text):
            return whole(self.tokenizer, text)
        if _PLAIN.match(text):
            return self._plain(text)
        return b"".join([self._plain(p) if _PLAIN.match(p) else whole(self.tokenizer, p) for p in self.cut(text)])

    def _plain(self, text: str) -> bytes:
        units = self.units
        return b"".join([units[u] for u in self.rule.findall(text.lower() if self.fold else text)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Gives back what encoder() keeps, in a worker that goes on to other work."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
