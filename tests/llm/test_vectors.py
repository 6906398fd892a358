"""Blocks of vectors meet where they were written: what is shuffled follows the vectors, not the pairs of blocks."""

import numpy as np
import pytest

from tests.llm import brute
from trivalent.llm import cover_tree


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK_BYTES", 8 * 64 * 25)
    if hasattr(cover_tree, "FILE_BYTES"):
        monkeypatch.setattr(cover_tree, "FILE_BYTES", 8 * 64 * 125)


def found(spark, rows, kind="array<double>"):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding {kind}")).collect()}


def test_shuffle_follows_the_vectors(spark, small_blocks):
    random = np.random.default_rng(11)
    vectors = random.normal(size=(800, 64))
    vectors[400:420] = vectors[0] + 0.1 * random.normal(size=(20, 64))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = shuffled()
    got = found(spark, rows)
    assert shuffled() - before < 10 * 800 * 64 * 8
    assert got == brute.near(rows)


def test_points_about_the_threshold(spark, small_blocks):
    """Single precision, a loose cluster that many links cross, copies, and lengths that share a block."""
    random = np.random.default_rng(12)
    heart = random.normal(size=64)
    vectors = [*(heart + 0.22 * random.normal(size=(150, 64))), *random.normal(size=(150, 64)), *np.repeat(random.normal(size=(2, 64)), 20, 0)]
    vectors += [v for size in (2, 3, 5) for v in random.normal(size=(12, size))]
    vectors = [np.float32(v) * np.float32(10.0 ** random.integers(-30, 30)) for v in vectors]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    want = brute.near([(i, [x / max(map(abs, v)) for x in v]) for i, v in rows])
    assert 1_000 < sum(n for n, _, _ in want.values()) < 149 * 150
    assert found(spark, rows, "array<float>") == want
