"""Best-fit-decreasing packing of tokenised documents into windows.

Documents longer than a window are first cut into full ones.  The rest is packed in blocks:
longest first, each into the open window that it fills most tightly, which a segment tree
over the remaining capacities finds in log(window) steps.  Pieces may be cut, so what best
fit leaves open is then closed: the emptiest windows are taken apart to fill the fullest,
and the last one is cut into powers of two, which need no padding.  All of it runs where the
documents lie; no row is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END = 0
SPECIAL = "<|endoftext|>"
#: White space in a row from which the matcher behind the ranks may run out of stack.
_RUN = re.compile(r"\s{10000}")


class ByteBpe:
    """Ids of the byte-level BPE vocabulary, as the ``tokenizers`` file ``name``.json gives them.

    The same vocabulary as ranks (``name``.tiktoken) gives the same ids at about five times the
    speed; a text with the special token's string goes to ``tokenizers`` itself, which reads it
    as one id, and so does one with a very long run of white space.
    """

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        self.json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text or len(text) >= 10_000 and _RUN.search(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


class Capacities:
    """Open windows by remaining capacity; ``take(n)`` gives the tightest that holds ``n`` more."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, at: int, by: int) -> None:
        at += self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest capacity of at least ``least``, and that capacity."""
        tree, at = self.tree, least + self.size
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not tree[at]:
                    at += 1
        capacity = at - self.size
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


Piece = tuple[object, int, np.ndarray, int]  # document, start, ids, ids of the document


def best_fit(pieces: list[Piece], window: int) -> list[list[Piece]]:
    order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k][2]))
    windows: list[list[Piece]] = []
    free = Capacities(window)
    for k in order:
        n = len(pieces[k][2])
        if found := free.take(n):
            at, capacity = found
            windows[at].append(pieces[k])
        else:
            at, capacity = len(windows), window
            windows.append([pieces[k]])
        if capacity > n:
            free.put(capacity - n, at)
    return windows


def _split(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)


def close(windows: list[list[Piece]], window: int) -> list[list[Piece]]:
    """The same ids in full windows, then in powers of two."""
    fill = [sum(len(p[2]) for p in w) for w in windows]
    out = [w for w, n in zip(windows, fill, strict=True) if n == window]
    rest = sorted(((n, k) for k, n in enumerate(fill) if n < window), reverse=True)
    tail = [windows[k] for _, k in rest]
    lengths = [n for n, _ in rest]
    lo, hi = 0, len(tail) - 1
    while lo < hi:
        while lengths[lo] < window and lo < hi:
            piece = tail[hi].pop()
            need = window - lengths[lo]
            if len(piece[2]) > need:
                piece, left = _split(piece, need)
                tail[hi].append(left)
            tail[lo].append(piece)
            lengths[lo] += len(piece[2])
            lengths[hi] -= len(piece[2])
            if not lengths[hi]:
                hi -= 1
        if lengths[lo] == window:
            out.append(tail[lo])
            lo += 1
    if lo == hi and lengths[lo]:
        last = tail[lo][::-1]
        for k in reversed(range(window.bit_length())):
            if lengths[lo] >> k & 1:
                got, need = [], 1 << k
                while need:
                    piece = last.pop()
                    if len(piece[2]) > need:
                        piece, left = _split(piece, need)
                        last.append(left)
                    got.append(piece)
                    need -= len(piece[2])
                out.append(got)
    return out


def pack_block(pieces: list[Piece], window: int) -> list[list[Piece]]:
    return close(best_fit(pieces, window), window)


SCHEMA = "id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    block_tokens: int = 1 << 22,
    block_pieces: int = 1 << 16,
    json_path: str | None = None,
    ranks_path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every row is a document of its own, repeated ids too; a null or empty text is its end id
    alone.  A block is what a task has read when ``block_tokens`` ids or ``block_pieces`` pieces
    wait, so memory is bounded whatever the partition or the number of texts; sequence ids are unique across tasks and stable when a task is run
    again.  Empty input gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = SCHEMA.format(kind=kind) + (", ids array<bigint>" if with_ids else "")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 33
        codec = ByteBpe(json_path, ranks_path)
        id_type: pa.DataType | None = None
        rows: list[tuple] = []

        def emit(sequence: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, total in sequence:
                row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, number, offset)
                rows.append((*row, ids.tolist()) if with_ids else row)
                offset += len(ids)
            number += 1

        def flush() -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 6, *[pa.list_(pa.int64())] * with_ids]
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)
            rows.clear()
            return batch

        wait: list[Piece] = []
        tokens = 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(codec.ids(text.as_py() or ""), np.uint32(END)).astype("<u4", copy=False)
                full = len(ids) // window * window
                for at in range(0, full, window):
                    emit([(doc, at, ids[at : at + window], len(ids))])
                    if len(rows) >= 4096:
                        yield flush()
                if full < len(ids):
                    wait.append((doc, full, ids[full:].copy(), len(ids)))
                    tokens += len(ids) - full
                if tokens >= block_tokens or len(wait) >= block_pieces:
                    for sequence in pack_block(wait, window):
                        emit(sequence)
                    wait, tokens = [], 0
                    yield flush()
        for sequence in pack_block(wait, window):
            emit(sequence)
        if rows:
            yield flush()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
