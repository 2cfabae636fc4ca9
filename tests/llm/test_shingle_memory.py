"""What a task holds while it makes shingles: bounded by a run of texts, not by the Arrow batch they came in."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import flat

MB = 1 << 20


@pytest.fixture
def texts():
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(1, 9))) for _ in range(5_000)]
    made = [" ".join(draw.choices(words, k=draw.randint(0, 700))) for _ in range(2_000)]
    return [*made[:700], None, "", " \t\n", "One two", "one  TWO", *made[700:]]


def sets(column, width):
    return [values[a:b].tolist() for _, values, edges in flat.shingle_sets(column, width) for a, b in zip(edges[:-1], edges[1:])]


@pytest.mark.parametrize("width", [4, 5])
def test_memory_of_a_run(texts, width, monkeypatch):
    monkeypatch.setattr(flat.Powers, "up", np.ones(1, np.uint64))
    monkeypatch.setattr(flat.Powers, "down", np.ones(1, np.uint64))
    column = pa.array(texts)
    assert column.nbytes > 3 * MB
    tracemalloc.start()
    for _ in flat.shingle_sets(column, width):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * MB


@pytest.mark.parametrize("width", [4, 5])
def test_sets_do_not_depend_on_the_run(texts, width, monkeypatch):
    """A text has the same set alone, in a short run, in a long one, and when it is longer than a run."""
    column = pa.array([*texts, " ".join(t for t in texts if t)])
    got = sets(column, width)
    assert len(got) == len(column)
    for size in (1, 1 << 12, 1 << 20, 1 << 24):
        monkeypatch.setattr(flat, "SHINGLE_BYTES", size)
        assert sets(column, width) == got
