"""Spans gathered in parts."""

from __future__ import annotations

import tracemalloc

import numpy as np

from profitlens.llm import slices


def test_gathered_holds_few_places_at_once():
    flat = np.arange(4_000_000, dtype=np.int64).astype(np.uint8)
    start = np.arange(0, len(flat), 20)[::-1].copy()
    size = np.full(len(start), 20)
    tracemalloc.start()
    got = slices.gathered(flat, start, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got.reshape(-1, 20) == flat.reshape(-1, 20)[::-1]).all()
    assert peak < 4 * len(flat)


def test_gathered_in_parts_of_any_size(monkeypatch):
    rng = np.random.default_rng(1)
    for part in (1, 7, 40, 1 << 17):
        monkeypatch.setattr(slices, "GATHER", part)
        for longest in (3, 30):
            n = int(rng.integers(0, 25))
            flat, start, size = rng.integers(0, 255, 200), rng.integers(0, 150, n), rng.integers(0, longest, n)
            want = np.concatenate([flat[:0], *(flat[a: a + b] for a, b in zip(start, size, strict=True))])
            assert (slices.gathered(flat, start, size) == want).all()
