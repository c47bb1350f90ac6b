"""Byte-level BPE ids of whole texts as the tokenizers library gives them, through a table of known pre-tokens."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

from tessella.llm.spans import HashTable, span_hashes

#: The characters of texts that are split here; any other text goes to the library whole.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_OTHER = "–—‘’“”…«»¿¡"
_UNUSUAL = re.compile(f"[^\x00-\x7f{_LETTERS}{_OTHER}]")
_CUT = re.compile(f"(?<=[{_LETTERS}]) (?=[{_LETTERS}])")

#: Classes of bytes: letter, digit, white space, anything else, and the end of a text (byte 255, not in UTF-8).
_L, _D, _S, _O, _END = range(5)
_CLASS = np.full(256, _O, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = _L
_CLASS[48:58] = _D
_CLASS[[32, *range(9, 14)]] = _S
_CLASS[255] = _END
_AFTER_LETTER = np.zeros(256, bool)
_AFTER_LETTER[[0xC3, 0xC4, 0xC5]] = True
#: What may follow an apostrophe in a pre-token of its own.
_ONE, _TWO = b"stmd", (b"re", b"ve", b"ll")

BLOCK = 1 << 19


def piece_starts(a: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts that each end with byte 255, which is a pre-token itself.

    The rule of the published pattern, by runs of one class: a run of letters, of digits or of other characters
    takes one space before it; white space before anything else gives up its last character; a lone apostrophe
    takes the ending of a contraction.
    """
    c = _CLASS[a]
    cont = np.flatnonzero((a & 0xC0) == 0x80)
    c[cont] = np.where(_AFTER_LETTER[a[cont - 1]], _L, _O)
    start = np.empty(len(a), bool)
    start[0] = True
    np.not_equal(c[1:], c[:-1], out=start[1:])
    last = np.flatnonzero((c[:-1] == _S) & (c[1:] != _S) & (c[1:] != _END))
    start[last] = True
    start[last[a[last] == 32] + 1] = False
    quote = np.flatnonzero(a[:-2] == 39) if len(a) > 2 else np.zeros(0, np.int64)
    if len(quote):
        before = np.where(quote > 0, a[quote - 1], 255)
        fresh = (before != 32) & ((quote == 0) | (c[quote - 1] != _O)) & (c[quote + 1] == _L)
        quote = quote[fresh]
        x, y = a[quote + 1], a[quote + 2]
        one = quote[np.isin(x, np.frombuffer(_ONE, np.uint8))]
        two = quote[np.any([(x == p[0]) & (y == p[1]) for p in _TWO], axis=0)]
        start[one + 1] = False
        start[one + 2] = True
        start[two + 1] = False
        start[two + 3] = True
    return np.flatnonzero(start)


def _byte_of() -> dict[str, int]:
    """The byte for each character by which a byte-level vocabulary writes it (the published byte-to-unicode rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file (.json).

    Texts are split into pre-tokens for a block at once, and each pre-token's 64-bit hash is looked up; a miss goes
    through the merges once. Texts with characters or vocabularies of another kind go to the library whole. The
    result is the library's in all cases, special strings included. ``bits``: log2 of the slots of the worker's
    cache, which is emptied when half full.
    """

    def __init__(self, path: str, bits: int = 20):
        import tiktoken
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added, model, pre = spec.get("added_tokens") or [], spec["model"], spec.get("pre_tokenizer") or {}
        self._special = {a["content"]: a["id"] for a in added}
        self._plain = (
            model["type"] == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges")
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added)
        )
        if self._plain:
            to, special = _byte_of(), set(self._special.values())
            ranks = {bytes(to[c] for c in w): i for w, i in model["vocab"].items() if i not in special}
            self._core = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
            self._marks = re.compile("|".join(map(re.escape, sorted(self._special, key=len, reverse=True)))) if self._special else None
        self._lengths = HashTable(bits, np.int64)
        self._places = HashTable(bits, np.int64)  # place in the pool << 32 | number of ids
        self._pool, self._used = np.zeros(1 << 16, np.uint32), 0

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return self._core._encode_single_piece(piece)

    def ordinary(self, text: str) -> bool:
        """Whether the text is split here; else the library takes it whole."""
        return self._plain and not _UNUSUAL.search(text) and not (self._marks and self._marks.search(text))

    def by_library(self, text: str) -> list[int]:
        return self._library.encode(text, add_special_tokens=False).ids

    @staticmethod
    def blocks(text: str, size: int = 0) -> Iterator[str]:
        """The text in blocks, cut between a letter and a space, where a pre-token ends in any case."""
        at, size = 0, size or BLOCK
        while len(text) - at > size and (m := _CUT.search(text, at + size)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def pieces(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
        """For block after block of ordinary texts: the text of each pre-token, its start, end and hash, and the bytes."""
        held, of, size = [], [], 0
        for k, text in enumerate(texts):
            for part in self.blocks(text):
                held.append(part.encode())
                of.append(k)
                size += len(held[-1])
                if size >= BLOCK:
                    yield self._block(held, of)
                    held, of, size = [], [], 0
        if held:
            yield self._block(held, of)

    @staticmethod
    def _block(parts: list[bytes], of: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        data = b"\xff".join(parts) + b"\xff"
        a = np.frombuffer(data, np.uint8)
        starts = piece_starts(a)
        ends = np.append(starts[1:], len(a))
        real = a[starts] != 255
        part = np.cumsum(~real) - ~real
        starts, ends = starts[real], ends[real]
        return np.array(of)[part[real]], starts, ends, span_hashes(a, starts, ends), data

    def counts(self, texts: list[str | None], frequent: HashTable | None = None) -> np.ndarray:
        """Number of ids of each text: pre-token lengths from ``frequent``, else from the cache, else by merging."""
        out = np.zeros(len(texts), np.int64)
        here = []
        for k, t in enumerate(texts):
            if t and self.ordinary(t):
                here.append(k)
            elif t:
                out[k] = len(self.by_library(t))
        place = np.array(here, np.int64)
        for of, s, e, h, data in self.pieces([texts[k] for k in here]):
            n, absent = frequent.find(h) if frequent is not None else (np.zeros(len(h), np.int64), np.ones(len(h), bool))
            n = n.astype(np.int64)
            if (miss := np.flatnonzero(absent)).size:
                got, unknown = self._lengths.find(h[miss])
                if unknown.any():
                    new, first = np.unique(h[miss[unknown]], return_index=True)
                    at = miss[unknown][first]
                    lengths = np.array([len(self.merged(data[i:j])) for i, j in zip(s[at].tolist(), e[at].tolist(), strict=True)], np.int64)
                    got[unknown] = lengths[np.searchsorted(new, h[miss[unknown]])]
                    if not self._lengths.room(len(new)):
                        self._lengths.clear()
                    if self._lengths.room(len(new)):
                        self._lengths.insert(new, lengths)
                n[miss] = got
            out += np.bincount(place[of], weights=n, minlength=len(out)).astype(np.int64)
        return out

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        here = []
        for k, t in enumerate(texts):
            if t and self.ordinary(t):
                here.append(k)
            elif t:
                out[k].append(np.array(self.by_library(t), np.uint32))
        for of, s, e, h, data in self.pieces([texts[k] for k in here]):
            v, absent = self._places.find(h)
            if absent.any():
                new, first = np.unique(h[absent], return_index=True)
                if not self._places.room(len(new)) or self._used > 1 << 23:
                    self._places.clear()
                    self._used = 0
                    v, absent = self._places.find(h)
                    new, first = np.unique(h, return_index=True)
                at = np.flatnonzero(absent)[first]
                ids = [self.merged(data[i:j]) for i, j in zip(s[at].tolist(), e[at].tolist(), strict=True)]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.uint32, int(n.sum()))
                if self._used + len(flat) > len(self._pool):
                    self._pool = np.concatenate([self._pool[: self._used], np.zeros(max(len(self._pool), len(flat)), np.uint32)])
                self._pool[self._used : self._used + len(flat)] = flat
                values = ((self._used + np.cumsum(n) - n) << 32) | n
                self._used += len(flat)
                v[absent] = values[np.searchsorted(new, h[absent])]
                if self._places.room(len(new)):
                    self._places.insert(new, values)
            n, at = v & 0xFFFFFFFF, v >> 32
            total = np.cumsum(n)
            flat = self._pool[np.repeat(at - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]
            cut = np.flatnonzero(np.diff(of)) + 1
            bounds = np.concatenate([[0], total[cut - 1], total[-1:]]).astype(np.int64)
            for k, i, j in zip(of[np.concatenate([[0], cut])] if len(of) else [], bounds[:-1], bounds[1:]):
                out[here[k]].append(flat[i:j])
        none = np.zeros(0, np.uint32)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]


_LOADED: dict[tuple[str, int], ByteBpe] = {}


def tokenizer_path(name: str) -> str:
    """A file that the executors have: an absolute path, or the name of a public vocabulary."""
    if name.startswith("/"):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def loaded(name: str, bits: int = 20) -> ByteBpe:
    """One tokenizer for each Python worker."""
    if (name, bits) not in _LOADED:
        _LOADED[name, bits] = ByteBpe(tokenizer_path(name), bits)
    return _LOADED[name, bits]
