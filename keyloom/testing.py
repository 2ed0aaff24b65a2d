"""Equality of frames, for tests."""

from __future__ import annotations

import math
from typing import Any

from .operators.frame import Frame


def _same(a: Any, b: Any) -> bool:
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def assert_frame_equal(left: Frame, right: Frame, ordered: bool = True) -> None:
    """Same index names, same set of columns, same values row by row, or in any order."""
    assert left._index == right._index, f"index {left._index} and {right._index}"
    assert set(left.columns) == set(right.columns), f"columns {left.columns} and {right.columns}"
    names = sorted(left.columns)
    a, b = list(left.iterrows(*names)), list(right.iterrows(*names))
    if not ordered:
        a, b = sorted(a, key=repr), sorted(b, key=repr)
    assert len(a) == len(b), f"{len(a)} and {len(b)} rows"
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        assert _same(x, y), f"row {k}: {x} and {y}"


def assert_index_equal(left: Frame, right: Frame, ordered: bool = True) -> None:
    """Same index names and the same keys."""
    assert left._index == right._index, f"index {left._index} and {right._index}"
    a, b = list(left.iterrows(*left._index)), list(right.iterrows(*right._index))
    assert (a if ordered else sorted(a, key=repr)) == (b if ordered else sorted(b, key=repr))
