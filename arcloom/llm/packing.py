"""Packing: order-preserving dynamic programming over window cuts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

#: Penalties in tokens: a window at all, a cut behind a sentence, a cut inside one.
WINDOW_COST, SENTENCE_COST, INSIDE_COST = 4, 1, 12


def cut_points(ends: np.ndarray, stops: np.ndarray, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and what each costs: documents' ends (ends), sentences' ends (stops), and inside sentences of over grain tokens every grain tokens."""
    n = int(ends[-1])
    known = np.unique(np.concatenate([[0], ends, stops]))
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > grain)
    inner = np.concatenate([np.arange(known[i] + grain, known[i + 1], grain) for i in wide]) if len(wide) else known[:0]
    cost = np.full(n + 1, 0, dtype=np.int64)
    cost[inner] = INSIDE_COST
    cost[stops] = SENTENCE_COST
    cost[ends] = 0
    at = np.unique(np.concatenate([known, inner]))
    return at, cost[at]


def best_windows(at: np.ndarray, cost: np.ndarray, width: int) -> list[int]:
    """Ends of the windows of the cheapest cover of positions at[0]..at[-1], each of at most width positions.

    A window costs its padding to width (none where its length is a power of two), WINDOW_COST and its cut's penalty.
    The cost of window (i, j) is a term of i plus a term of j, so the queue of candidates i with rising terms gives
    each j its best start at its head: every candidate enters and leaves once.
    """
    exact: dict[int, list[int]] = {}
    power = 64
    while power < width:
        start = np.searchsorted(at, at - power)
        for j in np.flatnonzero((at >= power) & (at[start] == at - power)):
            exact.setdefault(int(j), []).append(int(start[j]))
        power *= 2
    x, extra = at.tolist(), cost.tolist()
    best, back, term = [0], [0], [x[0]]
    queue: deque[int] = deque([0])
    for j in range(1, len(x)):
        here = x[j]
        while here - x[queue[0]] > width:
            queue.popleft()
        i = queue[0]
        low = term[i] + width - here
        if j in exact:
            for k in exact[j]:
                if best[k] < low:
                    low, i = best[k], k
        low += WINDOW_COST + extra[j]
        best.append(low)
        back.append(i)
        term.append(low + here)
        while queue and term[queue[-1]] >= low + here:
            queue.pop()
        queue.append(j)
    ends, j = [], len(x) - 1
    while j:
        ends.append(x[j])
        j = back[j]
    return ends[::-1]


def pack_stream(docs: Iterator[tuple[object, np.ndarray]], stop: np.ndarray, width: int, chunk: int, grain: int, first: int) -> Iterator[pa.Table]:
    """Pieces of a stream of (id, token ids), a table for every chunk of about that many tokens."""

    def flush() -> pa.Table:
        nonlocal first
        flat = np.concatenate(arrays).astype("<u4")
        sizes = np.array([len(a) for a in arrays], dtype=np.int64)
        ends = np.cumsum(sizes)
        at, cost = cut_points(ends, np.flatnonzero(stop[flat]) + 1, grain)
        windows = np.array(best_windows(at, cost, width), dtype=np.int64)
        edges = np.unique(np.concatenate([[0], ends, windows]))
        begin, length = edges[:-1], np.diff(edges)
        doc = np.searchsorted(ends, begin, side="right")
        seq = np.searchsorted(windows, begin, side="right")
        starts = np.concatenate([[0], windows[:-1]])
        data = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer((edges * 4).astype(np.int64)), pa.py_buffer(flat)])
        out = pa.table(
            {
                "doc_id": pa.array([names[d] for d in doc], type=kind),
                "start": begin - (ends - sizes)[doc],
                "length": length,
                "doc_tokens": sizes[doc],
                "sequence_id": first + seq,
                "offset": begin - starts[seq],
                "ids": data.cast(pa.binary()),
            }
        )
        first += len(windows)
        return out

    kind = None
    names: list = []
    arrays: list[np.ndarray] = []
    held = 0
    for name, kind, ids in docs:
        names.append(name)
        arrays.append(ids)
        held += len(ids)
        if held >= chunk:
            yield flush()
            names, arrays, held = [], [], 0
    if arrays:
        yield flush()


def pack_documents(
    df: DataFrame,
    width: int = 1024,
    vocabulary: str | None = None,
    end_id: int = 0,
    chunk: int = 1 << 21,
    grain: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack the documents of each input partition, in the order in which they are read, into sequences of at most width ids.

    A document is its byte-level BPE ids and end_id; a null text is an empty one, so every row gives at least one id.
    Rows stay where they are read: there is no shuffle, a partition holds one chunk of ids in memory, and only the last
    window of a chunk is filled up for want of more. Windows are cut by best_windows.

    Returns one row a piece: doc_id, start, length, doc_tokens, sequence_id, offset (long) and ids (the piece's ids as
    little-endian unsigned 32-bit integers). Repeated rows and repeated or null doc_ids are documents of their own, told
    apart by where they lie in the sequences; very long texts (long blank runs, too) are cut over sequences like any other. An empty table
    gives no rows. Extra columns are not read.
    """
    vocabulary = vocabulary or bpe.public_file("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stop = bpe.ends_sentence(vocabulary)

        def docs():
            for batch in batches:
                names, texts = batch.column(0), batch.column(1)
                for i in range(batch.num_rows):
                    ids = np.append(bpe.ids_of(vocabulary, texts[i].as_py() or ""), np.uint32(end_id))
                    yield names[i].as_py(), names.type, ids

        for out in pack_stream(docs(), stop, width, chunk, grain, TaskContext.get().partitionId() << 36):
            yield from out.to_batches(max_chunksize=20_000)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(
        run, f"{id_col} {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
