"""Byte-level BPE through pre-token caches: the tokenizers library encodes each distinct pre-token once per worker.

Texts of the Latin blocks are split by an expression that is proved equal to the library's; all others by the
library's own pre-tokenizer. Both give the same kind of pre-token, so table and cache serve every script.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable

import numpy as np

from . import common

#: Letters of ASCII and of the Latin blocks up to U+024F, in which re's classes and the tokenizer's agree.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: The byte-level split for texts without characters outside these blocks; the alternatives' order does not
#: matter where their first characters differ, so the commonest comes first.
_SPLIT = re.compile(rf" ?[{_L}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
#: Characters for which the split above is not known to be the tokenizer's.
_OTHER = re.compile(rf"[^\x00-\x1b\x20-\x7e¡-©«-±´¶-¸»¿×÷{_L}‐-‧‰-⁞€]")


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder(common.Cache):
    """Pre-token -> little-endian ids as bytes, or -> number of ids. `given` are looked up first and always kept.

    The library's own model encodes a missing pre-token; texts with special strings go to the library whole, and so
    do all where the tokenizer is no byte-level BPE.
    """

    def __init__(self, model: str, lengths: bool, given: dict[str, object] | None = None):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.lengths, self.given = Tokenizer.from_str(model), lengths, given or {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        about = json.loads(model)
        before = about.get("pre_tokenizer") or {}
        self.splits = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not about.get("normalizer") and about["model"].get("type", "BPE") == "BPE"
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.bytes = {ord(c): b for b, c in self.letters.items()}

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def value(self, key: str):
        if (known := self.given.get(key)) is not None:
            return known
        found = self.model.tokenize(key.encode().decode("latin-1").translate(self.letters))
        return len(found) if self.lengths else b"".join([t.id.to_bytes(4, "little") for t in found])

    def pre_tokens(self, text: str) -> list[str] | None:
        """The pre-tokens of a text, as the library splits it, or None where it has to encode the text whole."""
        if not self.splits or any(s in text for s in self.special):
            return None
        if not _OTHER.search(text):
            return _SPLIT.findall(text)
        return [t.translate(self.bytes).encode("latin-1").decode() for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if (parts := self.pre_tokens(text)) is None:
            return len(self._encode(text))
        return sum(map(self.__getitem__, parts))

    def ids(self, text: str) -> bytes:
        if (parts := self.pre_tokens(text)) is None:
            return np.asarray(self._encode(text), "<u4").tobytes()
        return b"".join(map(self.__getitem__, parts))


#: A worker's encoders: it keeps its cache from task to task.
_KEPT: dict[tuple, Encoder] = {}


def worker_encoder(model: str, lengths: bool, packed: tuple[bytes, bytes] | None = None) -> Encoder:
    key = (zlib.crc32(model.encode()), lengths, packed)
    if key not in _KEPT:
        _KEPT.clear()  # one at a time bounds the worker's memory
        _KEPT[key] = Encoder(model, lengths, unpack_table(packed) if packed else None)
    return _KEPT[key]


def read_model(path: str) -> str:
    """A tokenizer's file, read on the driver and sent to the workers with the function (1.5 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_table(rows: Iterable[tuple[str, int]]) -> tuple[bytes, bytes]:
    """Pre-tokens and their lengths as two compact byte strings."""
    rows = [(t, n) for t, n in rows if "\0" not in t and n < 256]
    return "\0".join(t for t, _ in rows).encode(), bytes(n for _, n in rows)


def unpack_table(packed: tuple[bytes, bytes]) -> dict[str, int]:
    return dict(zip(packed[0].decode().split("\0"), packed[1], strict=True)) if packed[1] else {}
