"""Exact token ids through a bounded cache of the encodings of pieces of text.

Both tokenizers treat what stands between runs of white space on its own, so the ids of a text
are those of its pieces in order. Most pieces repeat, and one look-up in a dictionary is an
order of magnitude cheaper than the library. Texts in which a piece could depend on its
neighbours go to the library whole.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Pieces of texts, and the parts that they are made of, kept per Python worker (about 200 bytes each).
CACHE_WORDS, CACHE_PARTS = 150_000, 600_000
#: Texts are worked through in groups of about so many bytes.
GROUP_BYTES = 3_000_000

#: Between an ASCII letter and ASCII punctuation other than the apostrophe both tokenizers always cut.
PART = re.compile(rb"(?<=[A-Za-z])(?=[!-&(-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z])")

TEXT_PART = re.compile(PART.pattern.decode())

_loaded: dict[tuple, object] = {}


def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer by its file's content and its library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


#: The forms (normaliser, pre-tokenizer) of the tokenizer files for which the cuts here are known to be exact.
WORD_FORM = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
BYTE_FORM = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})


def has_form(tokenizer, form: tuple, opening: str = "") -> bool:
    """Whether a tokenizer treats words as form does, and all its special strings begin with opening; else texts go to it whole."""
    import json

    d = json.loads(tokenizer.to_str())
    return (d["normalizer"], d["pre_tokenizer"]) == form and d["model"]["type"] == "BPE" and all(t["content"].startswith(opening) for t in d["added_tokens"])


class WordEncoder:
    """For lower-casing tokenizers that drop white space: ids as little-endian unsigned 32-bit bytes. Any other tokenizer gets texts whole."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.parts = load(path), {}
        self.cuts = has_form(self.tokenizer, WORD_FORM, "<|")

    def whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, texts: Iterable[memoryview]) -> Iterator[bytes]:
        """The ids of each text, in order. Memory is bounded by a group and the cache.

        numpy lower-cases and cuts a group's texts into parts, Arrow numbers the distinct ones, only those
        are looked up, and Arrow deals their ids out again. Texts with the opening of a
        special token's string are encoded whole.
        """
        import pyarrow as pa

        if not self.cuts:
            yield from (self.whole(bytes(t)) for t in texts)
            return
        for group in grouped(texts):
            plain = [bytes(t) for t in group]
            special = {k: self.whole(t) for k, t in enumerate(plain) if b"<|" in t}
            for k in special:
                plain[k] = b""
            coded, bounds = _parts(plain)
            parts = coded.dictionary.cast(pa.large_binary()).to_pylist()
            with no_collection():
                found = self.look_up(parts)
            sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
            ids = pa.array(np.frombuffer(b"".join(found), np.uint32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), ids)
            dealt = lists.take(coded.indices)
            flat = memoryview(dealt.values.to_numpy()).cast("B")
            ends = (4 * (dealt.offsets.to_numpy().astype(np.int64))[bounds]).tolist()
            for k, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                yield special[k] if k in special else bytes(flat[x:y])
            if len(self.parts) > CACHE_PARTS:
                self.parts = dict(zip(parts, found, strict=True))

    def look_up(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part; those not known yet are encoded together."""
        found = list(map(self.parts.get, parts))
        new = [k for k, x in enumerate(found) if x is None]
        for n in range(0, len(new), 5_000):
            some = new[n : n + 5_000]
            encoded = self.tokenizer.encode_batch_fast([parts[k].decode() for k in some], add_special_tokens=False)
            for k, e in zip(some, encoded, strict=True):
                found[k] = self.parts[parts[k]] = array("I", e.ids).tobytes()
        return found


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: 1 for ASCII letters, 2 for ASCII punctuation but the apostrophe.
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 2
_KIND[39] = 0


def _parts(texts: list[bytes]):
    """The parts of all texts in order, dictionary encoded, and where each text's begin (and the last ends)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    kind = _KIND[raw]
    cuts = np.flatnonzero(kind[:-1] + kind[1:] == 3) + 1  # a letter beside punctuation
    spaced = np.insert(_LOW[raw], cuts, 32)
    begins += np.searchsorted(cuts, begins)
    strings = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(begins), pa.py_buffer(spaced))
    lists = pc.ascii_split_whitespace(strings)
    return lists.values.dictionary_encode(), lists.offsets.to_numpy()


class ByteCounter:
    """For byte-level BPE with one leading space per word: numbers of tokens. Any other tokenizer gets texts whole."""

    PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+", re.ASCII)
    #: Blanks that are not ASCII's own: a run that mixes them isn't cut as PIECE cuts it.
    ODD_BLANK = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")

    def __init__(self, path: str) -> None:
        self.tokenizer, self.counts, self.parts = load(path), {}, {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = has_form(self.tokenizer, BYTE_FORM)

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, texts: Iterable[memoryview]) -> Iterator[int]:
        import pyarrow as pa

        if not self.cuts:
            yield from (self.whole(str(t, "utf-8")) for t in texts)
            return
        for group in grouped(texts):
            strings = [str(t, "utf-8") for t in group]
            pieces = [None if self.ODD_BLANK.search(t) or any(s in t for s in self.special) else self.PIECE.findall(t) for t in strings]
            coded = pa.array([x for p in pieces if p for x in p], pa.large_string()).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            with no_collection():
                self.learn(set(distinct))
            found = [self.counts[p] for p in distinct]
            ends = np.concatenate(([0], np.cumsum(np.array(found, np.int64)[coded.indices.to_numpy()]))) if found else np.zeros(1, np.int64)
            at = 0
            for t, p in zip(strings, pieces, strict=True):
                yield self.whole(t) if p is None else int(ends[at + len(p)] - ends[at])
                at += len(p or ())
            if len(self.counts) > CACHE_WORDS:
                self.counts = dict(zip(distinct, found, strict=True))
            if len(self.parts) > CACHE_PARTS:
                self.parts = {}

    def learn(self, pieces: set[str]) -> None:
        cut = {p: TEXT_PART.split(p) for p in pieces - self.counts.keys()}
        new = list(set().union(*cut.values()) - self.parts.keys())
        for k in range(0, len(new), 50_000):
            some = new[k : k + 50_000]
            self.parts.update(zip(some, map(len, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        find = self.parts.__getitem__
        self.counts.update((p, sum(map(find, c))) for p, c in cut.items())


@contextlib.contextmanager
def no_collection():
    """The many short-lived lists hold no cycles; looking for some takes a third of the time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def grouped(texts: Iterable[memoryview], limit: int = GROUP_BYTES) -> Iterator[list[memoryview]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def shared(kind: type, path: str):
    """One encoder for each Python worker, kept from task to task."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
