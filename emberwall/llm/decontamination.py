"""Benchmark decontamination by an Aho-Corasick automaton over normalised word windows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, only, text_views

WINDOW = 10
#: Most bytes of test texts: beyond, find_windows raises an error. A Python worker needs some 30 times as much memory.
MOST_BYTES = 1 << 27
#: Windows whose items a worker remembers.
REMEMBERED = 100_000
#: Column of the scan itself, beside those that a caller carries through.
SCANNED = "__scanned"
FOUND = "n_words long, hits array<struct<first:int,last:int,start:int,end:int>>, item_ids array<long>"

#: Word characters are ASCII letters and digits and all that isn't ASCII.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD_PATTERN = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text."""
    return text.translate(_WORD).split()


class Automaton:
    """One Aho-Corasick automaton whose letters are words, over all test texts; unknown words are one letter.

    Its patterns are pieces of the texts rather than all their windows, a tenth in size: any window of w words holds one
    of the pieces of (w + 1) // 2 words that begin at every (w + 2) // 2-th word of its text. Where a piece occurs, the
    windows around it are looked up in the sorted hashes of all windows, and compared word by word. Shorter texts are patterns themselves.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW) -> None:
        import ahocorasick

        self.letters: dict[bytes, int] = {}
        self.window, self.items, self.short, self.seen = window, [], [], {}
        piece, step = (window + 1) // 2, window + 1 - (window + 1) // 2
        number = lambda w: self.letters.setdefault(w, len(self.letters) + 1)
        patterns: dict[tuple, int] = {}  # twice the place in short (from 1), and 1 for a piece
        words, hashes, at, begins, short = [], [], [], [], {}
        for item, text in items:
            coded = tuple(map(number, words_of((text or "").encode("utf-8", "surrogatepass"))))
            if not coded:
                continue
            if len(coded) < window:
                short.setdefault(coded, set()).add(item)
                continue
            begins.append(len(words))
            self.items.append(item)
            for k in range(len(coded) - window + 1):
                hashes.append(hash(coded[k : k + window]))
                at.append(len(words) + k)
            for k in range(0, len(coded) - piece + 1, step):
                patterns[coded[k : k + piece]] = 1
            words += coded
        for coded, ids in short.items():
            self.short.append(ids)
            patterns[coded] = patterns.get(coded, 0) + 2 * len(self.short)
        order = np.argsort(np.array(hashes, np.int64), kind="stable")
        self.words, self.begins = np.array(words, np.int32), np.array(begins, np.int64)
        self.hashes, self.at = np.array(hashes, np.int64)[order], np.array(at, np.int64)[order]
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for coded, code in patterns.items():
            self.found.add_word(coded, (len(coded), code))
        if patterns:
            self.found.make_automaton()

    def items_of(self, coded: tuple[int, ...]) -> frozenset:
        """The items that have a window."""
        known = self.seen.get(coded)
        if known is None:
            lo, hi = np.searchsorted(self.hashes, hash(coded)), np.searchsorted(self.hashes, hash(coded), "right")
            at = self.at[lo:hi]
            same = [k for k in at.tolist() if self.words[k : k + self.window].tolist() == list(coded)]
            known = frozenset(self.items[k] for k in (np.searchsorted(self.begins, same, "right") - 1).tolist())
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[coded] = known
        return known

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
        """Spans of words (first, last) in any window, merged where they overlap or touch, and the items found."""
        letter, window = self.letters.get, self.window
        coded = tuple(letter(w, 0) for w in words)
        if not self.letters or not any(coded):
            return [], []
        hits, items, begun = [], set(), 0
        for last, (n, code) in self.found.iter(coded):
            first = last - n + 1
            if code > 1:
                items.update(self.short[code // 2 - 1])
                hits.append((first, last))
            if code & 1:
                # Windows that hold this piece; those that an earlier piece led to are done.
                for k in range(max(begun, last - window + 1), min(first, len(coded) - window) + 1):
                    if ids := self.items_of(coded[k : k + window]):
                        items.update(ids)
                        hits.append((k, k + window - 1))
                begun = max(begun, first + 1)
        spans: list[tuple[int, int]] = []
        for first, last in sorted(hits):
            if spans and spans[-1][1] >= first - 1:
                spans[-1] = (spans[-1][0], max(last, spans[-1][1]))
            else:
                spans.append((first, last))
        return spans, sorted(items, key=lambda x: (x is not None, x))


_built: dict[object, Automaton] = {}


def _scanner(shared, window: int, scanned: str):
    def run(batches):
        import pyarrow as pa

        key = shared.value[0]
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(shared.value[1], window)
        automaton, spans = _built[key], pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")]))
        for b in batches:
            n_words, hits, items = [], [], []
            for t in text_views(b.column(scanned)):
                words = bytes(t).translate(_WORD).split()
                found, ids = automaton.scan(words)
                n_words.append(len(words))
                items.append(ids)
                # Only texts with a hit are walked again, for their offsets in code points.
                at = [m.span() for m in _WORD_PATTERN.finditer(str(t, "utf-8"))] if found else []
                hits.append([{"first": x, "last": y, "start": at[x][0], "end": at[y][1]} for x, y in found])
            names = [k for k in b.schema.names if k != SCANNED]
            cols = [b.column(k) for k in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(hits, spans), pa.array(items, pa.list_(pa.int64()))], [*names, "n_words", "hits", "item_ids"])

    return run


def find_windows(docs: DataFrame, benchmark: DataFrame, *, carry: tuple[str, ...] = ("doc_id",), window: int = WINDOW) -> DataFrame:
    """Per row of docs (the columns of carry, and text): n_words, hits and the benchmark items with occurring windows.

    hits are spans of words (first and last word, start and end in code points of the original
    text) that any window covers. Every text is scanned whole, once, where it is read: nothing is shuffled. Null texts have no
    words; items without words have no window; items of fewer than window words are one. The test texts are
    broadcast; a benchmark of more than MOST_BYTES raises ValueError, and is to be scanned in parts.
    """
    spark: SparkSession = docs.sparkSession
    scanned = "text" if "text" in carry else SCANNED
    body = only(docs, *carry, *([] if scanned == "text" else ["text"])).toDF(*carry, *([] if scanned == "text" else [SCANNED]))
    items = only(benchmark, "item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of test texts are more than one automaton takes ({MOST_BYTES})")
    held = sorted((tuple(r) for r in items.collect()), key=repr)
    name = hashlib.sha256(repr((window, held)).encode("utf-8", "surrogatepass")).hexdigest()
    shared = spark.sparkContext.broadcast((name, held))
    ddl = ", ".join(f"`{c}` {t}" for c, t in body.dtypes if c != SCANNED)
    return body.transform(in_arrow, _scanner(shared, window, scanned), f"{ddl}, {FOUND}")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of find_windows' result."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    ids = F.array_join(F.sort_array(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
