"""Shortest moves on eight-neighbour grids: distances from the goal, level by level, for a whole Arrow batch of boards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import GRID_MOVES

#: Boards whose distances are held at once.
_BOARDS = 1024


def _distances(free: np.ndarray, goal: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Moves to the goal for every cell (-1: none); boards (n, rows, columns) have a closed border."""
    n = len(free)
    away = np.full(free.shape, -1, np.int32)
    ring = np.zeros(free.shape, bool)
    ring[np.arange(n), goal[0], goal[1]] = True
    ring &= free
    level = 0
    while ring.any():
        away[ring] = level
        level += 1
        near = np.zeros(free.shape, bool)
        for dr, dc in GRID_MOVES.values():
            near |= np.roll(ring, (-dr, -dc), axis=(1, 2))
        ring = near & free & (away < 0)
    return away


def _descents(away: np.ndarray, start: tuple[np.ndarray, np.ndarray]) -> list[list[str] | None]:
    """From each start the first move in compass order that comes nearer, until the goal."""
    board = np.arange(len(away))
    r, c = (x.copy() for x in start)
    left = away[board, r, c]
    moves: list[list[str] | None] = [[] if d >= 0 else None for d in left]
    while True:
        open_ = np.flatnonzero(left > 0)
        if not len(open_):
            return moves
        for name, (dr, dc) in GRID_MOVES.items():
            nearer = open_[away[open_, r[open_] + dr, c[open_] + dc] == left[open_] - 1]
            for i in nearer:
                moves[i].append(name)
            r[nearer] += dr
            c[nearer] += dc
            left[nearer] -= 1
            open_ = np.setdiff1d(open_, nearer, assume_unique=True)


def _paths(size: pd.Series, r0: pd.Series, c0: pd.Series, r1: pd.Series, c1: pd.Series, obstacles: pd.Series) -> pd.Series:
    out: list[list[str] | None] = []
    for lo in range(0, len(size), _BOARDS):
        part = slice(lo, lo + _BOARDS)
        n = size.iloc[part].to_numpy(int)
        inside = np.arange(n.max() + 2)
        inside = (inside >= 1) & (inside <= n[:, None])
        free = inside[:, :, None] & inside[:, None, :]
        for i, cells in enumerate(obstacles.iloc[part]):
            for cell in cells:
                row, column = map(int, cell.split(","))
                free[i, row + 1, column + 1] = False
        ends = [tuple(x.iloc[part].to_numpy(int) + 1 for x in pair) for pair in ((r0, c0), (r1, c1))]
        away = _distances(free, ends[1])
        out += _descents(away, ends[0])
    return pd.Series(out)


def best_moves(size: int, start: tuple[int, int], goal: tuple[int, int], blocked: set) -> list[str] | None:
    """A shortest move list; of several the first in compass order from north, clockwise; None if unreachable."""
    one = [pd.Series([v]) for v in (size, *start, *goal, [f"{r},{c}" for r, c in blocked])]
    return _paths(*one)[0]


def grid_path(*columns: Column) -> Column:
    """Moves for (size, row, column, goal row, goal column, obstacles ARRAY<STRING> of ``row,column``)."""
    return F.pandas_udf(_paths, "array<string>")(*columns)
