"""Sum-of-squares packing of tokenised documents into fixed windows.

Documents arrive one after the other.  Whole windows are cut off a document that
is longer than a window; the rest of it goes to the fill level at which the sum,
over all fill levels, of the squared number of partially filled windows becomes
smallest.  A level array holds those numbers, so a placement is one vector
operation, whatever the number of open windows.

Each task packs the rows of its own partition and numbers its sequences from its
partition number, so nothing is shuffled and no state is shared.  Open windows
are bounded by *max_open*: beyond that, and at the end of a task, windows that
are still partial are topped up with pieces cut from the emptiest ones, which
leaves at most one padded window a task.  The rows of a partition must arrive in
the same order if a task is repeated; stored tables do.

Defined results: a null or empty text is the end token alone; repeated rows are
packed once each; a null ``doc_id`` is carried along; other columns are not
read; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leadmill.llm import bpe

#: Pieces handed back to Spark at a time.
BATCH_PIECES = 512
_NO_WINDOW = -(1 << 40)


class LevelArray:
    """Number of partially filled windows at each fill level, and what moving one changes."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self._count = np.zeros(capacity + 1, np.int64)
        self._gain = np.full(capacity + 1, _NO_WINDOW, np.int64)  # a window leaves the level
        self._gain[0] = 0
        self._price = np.ones(capacity + 1, np.int64)  # a window comes to the level
        self._price[capacity] = 0

    def add(self, level: int, change: int) -> None:
        if 0 < level < self.capacity:
            n = self._count[level] = self._count[level] + change
            self._gain[level] = 2 * n - 1 if n else _NO_WINDOW
            self._price[level] = 2 * n + 1

    def best(self, size: int) -> int:
        """Level to put *size* on; the fullest among equals, 0 for a new window."""
        change = self._price[size:] - self._gain[: self.capacity - size + 1]
        return len(change) - 1 - int(change[::-1].argmin())


class Packer:
    """Packs (document, ids) one by one; hands out finished windows as piece lists.

    A piece is [document, start, ids, document length].
    """

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self._max_open = capacity, max_open
        self._levels = LevelArray(capacity)
        self._open: dict[int, list[list]] = {}
        self._n_open = 0

    def add(self, doc, ids: bytes) -> Iterator[list]:
        total, width = len(ids) // 4, self.capacity * 4
        whole = len(ids) // width * width
        for at in range(0, whole, width):
            yield [[doc, at // 4, ids[at : at + width], total]]
        if whole < len(ids):
            yield from self._place([doc, whole // 4, ids[whole:], total])
        if self._n_open > self._max_open:
            yield from self.top_up(last=False)

    def _place(self, piece: list) -> Iterator[list]:
        size = len(piece[2]) // 4
        level = self._levels.best(size)
        if level:
            window = self._open[level].pop()
            self._levels.add(level, -1)
            self._n_open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.capacity:
            yield window
        else:
            self._keep(level + size, window)

    def _keep(self, fill: int, window: list) -> None:
        self._open.setdefault(fill, []).append(window)
        self._levels.add(fill, 1)
        self._n_open += 1

    def top_up(self, last: bool) -> Iterator[list]:
        """Fill the fullest open windows with pieces cut from the emptiest."""
        windows = [[fill, w] for fill in sorted(self._open, reverse=True) for w in self._open[fill]]
        self._open, self._n_open, self._levels = {}, 0, LevelArray(self.capacity)
        low, high = 0, len(windows) - 1
        while low < high:
            gap = self.capacity - windows[low][0]
            doc, start, ids, total = windows[high][1].pop()
            moved, left = ids[: gap * 4], ids[gap * 4 :]
            windows[low][1].append([doc, start, moved, total])
            windows[low][0] += len(moved) // 4
            windows[high][0] -= len(moved) // 4
            if left:
                windows[high][1].append([doc, start + gap, left, total])
            if windows[low][0] == self.capacity:
                yield windows[low][1]
                low += 1
            if not windows[high][1]:
                high -= 1
        if low == high and windows[low][0]:
            if last or windows[low][0] == self.capacity:
                yield windows[low][1]
            else:
                self._keep(*windows[low])


def pack(docs: DataFrame, vocabulary: str, *, capacity: int = 4096, end_id: int = 2,
         max_open: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in windows of *capacity* ids.

    One row per piece: ``doc_id, start, length, ids`` (binary, little-endian
    unsigned 32-bit), ``doc_tokens, sequence_id, offset``.  Every document ends
    with *end_id*; every id lies in exactly one piece.
    """
    spec = docs.sparkSession.sparkContext.broadcast(bpe.read_spec(vocabulary))
    id_type = docs.schema[id_col].dataType
    id_arrow = to_arrow_type(id_type)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        codec = bpe._codec(spec.value)
        packer = Packer(capacity, max_open)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def windows():
            for batch in bpe.slices(batches):
                ids = codec.encode_all(batch.column(1).to_pylist())
                for doc, own in zip(batch.column(0).to_pylist(), ids):
                    yield from packer.add(doc, own + end)
            yield from packer.top_up(last=True)

        for window in windows():
            offset = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                rows.append((doc, start, n, ids, total, sequence, offset))
                offset += n
            sequence += 1
            if len(rows) >= BATCH_PIECES:
                yield _batch(rows, id_arrow)
                rows = []
        yield _batch(rows, id_arrow)

    schema = (
        f"doc_id {id_type.simpleString()}, start long, length long, ids binary, "
        "doc_tokens long, sequence_id long, offset long"
    )
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _batch(rows: list[tuple], id_arrow: pa.DataType) -> pa.RecordBatch:
    types = [id_arrow, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=names
    )
