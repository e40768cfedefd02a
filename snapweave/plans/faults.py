"""Faults for tests: named points at which a job can be made to fail."""

from __future__ import annotations

from ..schema import EngineError

POINTS = ("before_chunks", "after_chunks", "before_manifest", "after_manifest", "before_marker", "after_marker")
_armed: dict[str, list] = {}


def arm(point: str, code: str = "fault-injected", skip: int = 0, most: int = 1) -> None:
    """Fail at this point with this code, after `skip` passes, at most `most` times."""
    if point not in POINTS:
        raise ValueError(point)
    _armed[point] = [code, skip, most]


def clear() -> None:
    _armed.clear()


def reach(point: str) -> None:
    """Where a job passes a point."""
    if f := _armed.get(point):
        if f[1]:
            f[1] -= 1
        elif f[2]:
            f[2] -= 1
            raise EngineError(f[0], point)
