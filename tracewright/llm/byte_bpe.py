"""Byte-level BPE over pre-tokens, with the whole-token shortcut.

A pre-token that is itself a vocabulary string which encodes alone as one
token is looked up; only the rest is merged, and the merged ones are
remembered up to a bound. Which strings do is proved once, on the driver, by
merging every vocabulary string; workers get the proof as a bit for each id."""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import regex
import tiktoken
from tokenizers import Tokenizer

#: The pre-token pattern of the vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same classes for texts whose code points are all below 256.
_SPACE, _LETTER, _NUMBER = r"\t-\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
NARROW = rf" ?[{_LETTER}]+| ?[{_NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Bytes of pre-tokens kept in each of two generations, and the longest that is kept.
REMEMBERED_BYTES, REMEMBERED_CHARS = 32_000_000, 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class _Memory(dict):
    """pre-token -> little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, proven: dict[str, bytes], merge: Callable[[bytes], list[int]]) -> None:
        super().__init__()
        self._proven, self._merge, self._older, self._bytes = proven, merge, {}, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self._proven.get(piece) or self._older.get(piece) or array("I", self._merge(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= REMEMBERED_CHARS:
            self._bytes += 200 + 2 * len(piece) + len(ids)
            if self._bytes > REMEMBERED_BYTES:
                self._older, self._bytes = self.copy(), 0
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def proof(path: str) -> bytes:
    """A bit for each id: whether its vocabulary string encodes alone as that one token."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    model = Tokenizer.from_file(path).model
    bits = bytearray(max(vocabulary.values()) // 8 + 1)
    for word, i in vocabulary.items():
        if len(found := model.tokenize(word)) == 1 and found[0].id == i:
            bits[i // 8] |= 1 << i % 8
    return bytes(bits)


class ByteBpe:
    def __init__(self, path: str, proved: bytes) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._path, back = path, {c: b for b, c in enumerate(byte_letters())}
        proven: dict[str, bytes] = {}
        for word, i in spec["model"]["vocab"].items():
            if proved[i // 8] >> i % 8 & 1:
                try:
                    proven[bytes(back[c] for c in word).decode()] = i.to_bytes(4, "little")
                except (KeyError, UnicodeDecodeError):
                    continue
        self.proven = proven
        self._ids = _Memory(proven, self._merger(spec, back))
        self.special = {t["content"]: t["id"].to_bytes(4, "little") for t in spec.get("added_tokens", [])}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._narrow, self._wide = re.compile(NARROW), regex.compile(PATTERN)

    @property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self._path)

    def _merger(self, spec: dict, back: dict[str, int]) -> Callable[[bytes], list[int]]:
        """Merging of one pre-token: by rank where ids follow the order of merges, else by the library's own model."""
        ranks = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items() if all(c in back for c in word)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if sys.byteorder == "little" and all(spec["model"]["vocab"][a + b] == 256 + k for k, (a, b) in enumerate(merges)) and sorted(i for w, i in ranks.items() if len(w) == 1) == list(range(256)):
            return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        letters, model = byte_letters(), self.library.model
        return lambda piece: [t.id for t in model.tokenize("".join([letters[b] for b in piece]))]

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers; special strings become their ids, as the library does by default."""
        if self._cut is not None and any(s in text for s in self.special):
            return b"".join(self.special.get(part) or self._plain(part) for part in self._cut.split(text) if part)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            pattern = self._narrow
        except UnicodeEncodeError:
            pattern = self._wide
        return b"".join(map(self._ids.__getitem__, pattern.findall(text)))


@lru_cache(maxsize=2)
def load(path: str, proved: bytes | None = None) -> ByteBpe:
    """One table a Python worker, from the driver's proof."""
    return ByteBpe(path, proof(path) if proved is None else proved)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
