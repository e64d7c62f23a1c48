import numpy as np
import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import neardup  # noqa: E402


def test_radius_loses_no_linked_pair():
    rng = np.random.default_rng(5)
    for shared, apart in ((60, 40), (90, 60), (300, 200), (1500, 1000)):
        for _ in range(2000 if shared < 100 else 300):
            runs = rng.integers(0, 1 << 63, shared + apart, dtype=np.uint64)
            a, b = np.concatenate([runs[:shared], runs[shared : shared + apart // 2]]), np.concatenate([runs[:shared], runs[shared + apart // 2 :]])
            x = neardup._sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert np.bitwise_count(x[0] ^ x[1]).sum() <= neardup.radius(np.array([len(a) + len(b)], dtype=float), 0.6)[0]
    # a pair of long texts can differ in nearly every bit
    assert neardup.radius(np.array([5000.0]), 0.6)[0] == neardup.BITS
