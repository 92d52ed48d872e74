"""Hierarchical multi-length packing.

Documents (ids and an end id) are routed to the tier of the smallest context size that holds them; longer ones first give full windows of
the largest size, without padding. Tiers are packed from the longest down: every document left in a tier opens a window of its size, whose
gap is filled with the longest whole piece of a shorter tier that fits, again and again, and only what is then missing is cut from the
longest piece that is left. Every window is thus full. What remains at the end of a buffer is cut at powers of two. Sequences of a
buffer are dealt to step groups of about equal tokens, the longest first.

Packing works on buffers of some million ids inside one partition, with no shuffle; memory is bounded by the buffer and the longest text.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import Encoder, path_of

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
TIERS = (1024, 512, 256, 128)


class Shelf:
    """Pieces by length, with the longest that fits in one step."""

    def __init__(self, longest: int):
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.mask = 0

    def put(self, doc: int, start: int, length: int) -> None:
        if length:
            self.at[length].append((doc, start))
            self.mask |= 1 << length

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most `most` ids."""
        n = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < 1:
            return None
        doc, start = self.at[n].pop()
        if not self.at[n]:
            self.mask ^= 1 << n
        return doc, start, n


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (size, pieces (document number, start, length)): every id once, every size a power of two of at most tiers[0]."""
    top, out = tiers[0], []
    shelf = Shelf(top)
    for i in range(len(lengths) - 1, -1, -1):  # pop() then takes equal lengths in document order
        n = lengths[i]
        for s in range(0, n - top + 1, top):
            out.append((top, [(i, s, top)]))
        shelf.put(i, n - n % top, n % top)
    left = sum(n % top for n in lengths)
    for k, size in enumerate(tiers):
        below = tiers[k + 1] if k + 1 < len(tiers) else 0
        while left >= size and shelf.mask.bit_length() - 1 > below:
            pieces, gap = [], size
            first = shelf.take(size)
            if first is None:  # only longer pieces are left, which larger tiers couldn't fill up
                break
            while first:
                pieces.append(first)
                gap -= first[2]
                first = shelf.take(gap) if gap else None
            if gap:  # nothing fits whole: cut it from the longest piece
                doc, start, n = shelf.take(top)
                pieces.append((doc, start, gap))
                shelf.put(doc, start + gap, n - gap)
            out.append((size, pieces))
            left -= size
    while left:  # the rest, at powers of two
        size = min(top, 1 << (left.bit_length() - 1))
        pieces, gap = [], size
        while gap:
            doc, start, n = shelf.take(gap) or shelf.take(top)
            use = min(n, gap)
            pieces.append((doc, start, use))
            shelf.put(doc, start + use, n - use)
            gap -= use
        out.append((size, pieces))
        left -= size
    return out


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group number for each sequence: the longest first to the group with the fewest ids."""
    n = max(1, -(-sum(sizes) // step_tokens))
    heap, of = [(0, g) for g in range(n)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        t, g = heap[0]
        of[i] = g
        heapq.heapreplace(heap, (t + sizes[i], g))
    return of


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id", tiers: tuple[int, ...] = TIERS, buffer_ids: int = 2_000_000, step_tokens: int = 65_536) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the sequence's size), step_group.

    A null or empty text is the end id alone. Rows with equal doc_ids (null ones too) are separate documents. tiers are descending powers
    of two. sequence_id and step_group hold the number of the input partition in their upper bits. An empty table gives an empty result.
    """
    assert all(t & (t - 1) == 0 for t in tiers) and list(tiers) == sorted(tiers, reverse=True)
    end = int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        base = TaskContext.get().partitionId() << 36
        held: list[tuple[object, bytes]] = []
        total, sequences, groups = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, total, sequences, groups
            packed = pack([len(b) // 4 for _, b in held], tiers)
            group = step_groups([s for s, _ in packed], step_tokens)
            rows = []
            for k, (size, pieces) in enumerate(packed):
                offset = 0
                for d, start, n in pieces:
                    rows.append((d, start, n, zlib.crc32(memoryview(held[d][1])[4 * start : 4 * (start + n)]), len(held[d][1]) // 4, base + sequences + k, offset, size, base + groups + group[k]))
                    offset += n
            cols = list(zip(*rows))
            arrays = [pa.array([held[d][0] for d in cols[0]], kind)] + [pa.array(np.array(c, np.int64)) for c in cols[1:7]] + [pa.array(np.array(cols[7], np.int32)), pa.array(np.array(cols[8], np.int64))]
            sequences += len(packed)
            groups += max(group) + 1
            held, total = [], 0
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])

        for b in batches:
            kind = b.schema.field("doc_id").type
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encoder.encode(t or "") + end
                held.append((i, ids))
                total += len(ids) // 4
                if total >= buffer_ids:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def op7_multi_length_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path_of("byte_bpe_50k.json"), end_id=0)
