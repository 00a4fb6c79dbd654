"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import heapq
import zlib

from pyspark.sql import DataFrame

from . import encoding
from .common import in_arrow, only, text_views

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"

#: Attention cost of a document of n tokens: n times LINEAR plus n squared times QUADRATIC.
LINEAR, QUADRATIC = 1.0, 1 / 4096
#: Ids that a task gathers before it packs them (16 MB): about a thousand sequences.
POOL_TOKENS = 1 << 22


class LeastCost:
    """Finds the sequence of least cost among those with enough room.

    A tree over room (0 to capacity) holds the least cost of each span of rooms; sequences of
    equal room wait in a heap. Both steps take log(capacity) time.
    """

    def __init__(self, capacity: int, sequences: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.best: list[tuple] = [(float("inf"), -1)] * (2 * self.width)
        self.heaps: dict[int, list] = {capacity: [(0.0, k) for k in range(sequences)]}
        self._renew(capacity)

    def _renew(self, room: int) -> None:
        heap, at = self.heaps.get(room), room + self.width
        self.best[at] = heap[0] if heap else (float("inf"), -1)
        while at > 1:
            at //= 2
            self.best[at] = min(self.best[2 * at], self.best[2 * at + 1])

    def take(self, least_room: int) -> tuple[float, int, int] | None:
        """Removes and gives (cost, sequence, its room), or None if none has that room."""
        found, a, b = (float("inf"), -1), least_room + self.width, 2 * self.width
        at = 0
        while a < b:
            if a & 1:
                found, at = min((found, at), (self.best[a], a))
                a += 1
            if b & 1:
                b -= 1
                found, at = min((found, at), (self.best[b], b))
            a, b = a // 2, b // 2
        if found[1] < 0:
            return None
        while at < self.width:
            at = 2 * at if self.best[2 * at] == found else 2 * at + 1
        room = at - self.width
        heapq.heappop(self.heaps[room])
        self._renew(room)
        return (*found, room)

    def put(self, cost: float, sequence: int, room: int) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), (cost, sequence))
        self._renew(room)


def cost_of(n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


def pack_lengths(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int, float]]:
    """Pieces (document, start, length, sequence, offset, cost) for documents of the given lengths.

    Documents longer than a sequence give whole sequences first. What remains goes, longest
    first, to the full-length sequence of least cost that has room; a document for which none
    has room is cut over the largest rooms left. There are as many full sequences as all tokens
    fill, so they end exactly full. The tokens left over, fewer than a sequence, fill
    sequences of a power of two each: no padding is needed anywhere.
    """
    total = sum(lengths)
    full = total // capacity
    out, rest, sequence = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            out.append((d, k * capacity, capacity, sequence, 0, cost_of(capacity, linear, quadratic)))
            sequence += 1
        if n > whole * capacity:
            rest.append((n - whole * capacity, d, whole * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    first, open_ = sequence, LeastCost(capacity, full - sequence)
    late = []
    for n, d, start in rest:
        if (got := open_.take(n)) is None:
            late.append((n, d, start))
            continue
        cost, k, room = got
        cost += cost_of(n, linear, quadratic)
        out.append((d, start, n, first + k, capacity - room, cost_of(n, linear, quadratic)))
        open_.put(cost, k, room - n)
    holes = sorted(((room, k) for room, heap in open_.heaps.items() if room for _, k in heap), reverse=True)
    left, bit = total - full * capacity, full
    spans = [(first + k, capacity - room, room) for room, k in holes]
    for power in range(left.bit_length() - 1, -1, -1):
        if left >> power & 1:
            spans.append((bit, 0, 1 << power))
            bit += 1
    at, used = 0, 0
    for n, d, start in late:
        while n:
            sequence, offset, room = spans[at]
            m = min(n, room - used)
            out.append((d, start, m, sequence, offset + used, cost_of(m, linear, quadratic)))
            n, start, used = n - m, start + m, used + m
            if used == room:
                at, used = at + 1, 0
    return out


def _packer(path: str, end_id: int, capacity: int, pool_tokens: int, linear: float, quadratic: float):
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = encoding.shared(encoding.WordEncoder, path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.float64() if n == "cost" else pa.int64() for n in names]
        base = TaskContext.get().partitionId() << 40  # sequence ids of a task are its own
        docs, held, size = [], [], 0

        def flush():
            nonlocal base, docs, held, size
            rows, top = [], -1
            for d, start, n, sequence, offset, cost in pack_lengths([len(x) // 4 for x in held], capacity, linear, quadratic):
                top = max(top, sequence)
                rows.append((docs[d], start, n, zlib.crc32(memoryview(held[d])[4 * start : 4 * (start + n)]), len(held[d]) // 4, base + sequence, offset, cost))
            base, docs, held, size = base + top + 1, [], [], 0
            for k in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 50_000], strict=True), kinds, strict=True)], names)

        for b in batches:
            for d, e in zip(b.column("doc_id").to_pylist(), encoder.encode(text_views(b.column("text"))), strict=True):
                docs.append(d)
                held.append(e + end)
                size += len(e) // 4 + 1
                if size >= pool_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return run


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 2, capacity: int = 4096, pool_tokens: int = POOL_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece of docs(doc_id, text); see pack_lengths for the rule.

    Nothing is shuffled: each task packs the documents it reads in pools of pool_tokens ids,
    so its memory is bounded by a pool and one document, and a lost task is simply run
    again. Null texts are empty and give the end id alone; repeated rows are packed each.
    An empty table gives no rows.
    """
    return only(docs, "doc_id", "text").transform(in_arrow, _packer(tokenizer, end_id, capacity, pool_tokens, linear, quadratic), SCHEMA)
