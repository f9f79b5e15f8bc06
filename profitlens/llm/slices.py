"""Slices of Arrow batches by bytes of text, and texts as runs of distinct chunks inside a slice."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def released(run: Callable) -> Callable:
    """``run`` over a task's batches; what it held goes back to the system at its end, as a worker may wait long for
    its next task (freed blocks stay with the allocators otherwise)."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim:
            trim(0)

    return ended


def filled(column: pa.Array) -> pa.Array:
    """A text column without nulls, as one array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes of ``column`` (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        lo = 0
        while lo < b.num_rows:
            hi = min(b.num_rows, max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1))
            yield b.slice(lo, hi - lo)
            lo = hi
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds nothing back


def cut(texts: pa.Array, at: str | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at ``at`` (None: at runs of [\\x20\\x09-\\x0D]): the distinct chunks, the chunk of each place, and
    the first place of each text (n + 1).  Cutting at a string keeps empty chunks; cutting at white space gives
    one only at an end of a text."""
    parts = pc.ascii_split_whitespace(texts) if at is None else pc.split_pattern(texts, at)
    first = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), first - (first[0] if len(first) else 0)


#: Values that ``gathered`` places at once; a span longer than this is placed alone.
GATHER = 1 << 17


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans [start, start + size) of ``flat``, one after the other.  Places take 8 bytes a value and more, so
    only those of ``GATHER`` values are held at a time."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, dtype=flat.dtype)
    lo = 0
    while lo < len(ends):
        begin = int(ends[lo] - size[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, begin + GATHER, side="right")))
        end = int(ends[hi - 1])
        if hi == lo + 1:
            out[begin:end] = flat[int(start[lo]): int(start[lo]) + end - begin]
        else:
            shift = start[lo:hi] - (ends[lo:hi] - size[lo:hi])
            out[begin:end] = flat[np.arange(begin, end) + np.repeat(shift, size[lo:hi])]
        lo = hi
    return out


class Memo:
    """Packed results of chunks met lately: two generations, the older of which is dropped when the younger is
    full, so that frequent chunks stay and memory is bounded.  Long chunks are not kept."""

    def __init__(self, entries: int, longest: int = 64) -> None:
        self.entries, self.longest = entries, longest
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def fill(self, chunks: list[str], make) -> list:
        """The result of each chunk; ``make`` gives those of the list of unknown ones."""
        get, old = self.new.get, self.old
        out = [get(c) for c in chunks]
        late = [i for i, v in enumerate(out) if v is None]
        if late:
            unknown = []
            for i in late:
                v = old.get(chunks[i])
                if v is None:
                    unknown.append(i)
                else:
                    out[i] = v
            for i, v in zip(unknown, make([chunks[i] for i in unknown]) if unknown else [], strict=True):
                out[i] = v
            for i in late:
                if len(chunks[i]) <= self.longest:
                    if len(self.new) >= self.entries:
                        self.old, self.new = self.new, {}
                    self.new[chunks[i]] = out[i]
        return out
