"""Stateful decision loop over a stream of moves, and the sinks of a scored stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.geometry import GRID_MOVES

OUT = "session string, row int, col int, steps int, status string"
STATE = "row int, col int, steps int, status string"


def stepper(size: int, start: tuple[int, int], goal: tuple[int, int], blocked: set, most: int = 100) -> Callable:
    """State function for ``applyInPandasWithState``: a session's moves in arrival order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        row, col, steps, status = state.get if state.exists else (*start, 0, "goal" if start == goal else "open")
        moves = pd.concat(list(batches)).sort_values("seq")["move"]
        for move in moves:
            if status != "open":
                break
            name = str(move).strip().upper()
            if move == "NONE":
                status = "NONE"
            elif name not in GRID_MOVES:
                status = "invalid"
            else:
                r, c = row + GRID_MOVES[name][0], col + GRID_MOVES[name][1]
                if not (0 <= r < size and 0 <= c < size):
                    status = "outside"
                elif (r, c) in blocked:
                    status = "blocked"
                elif steps >= most:
                    status = "exceeded"
                else:
                    row, col, steps = r, c, steps + 1
                    status = "goal" if (row, col) == goal else "open"
        state.update((row, col, steps, status))
        yield pd.DataFrame([(key[0], row, col, steps, status)], columns=["session", "row", "col", "steps", "status"])

    return step


def decide(moves: DataFrame, size: int, start: tuple[int, int], goal: tuple[int, int], blocked=frozenset(), most: int = 100) -> DataFrame:
    """``moves``: streaming (session STRING, seq LONG, move STRING); emits a session's state whenever it changes."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return moves.groupBy("session").applyInPandasWithState(stepper(size, start, goal, set(blocked), most), OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def append_scored(stream: DataFrame, path: str, checkpoint: str, score: Callable[[DataFrame], DataFrame]):
    """Score every micro-batch and append it; a batch that runs again overwrites its own folder, so rows appear once."""

    def sink(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def retried(render: Callable[[dict], dict], check: Callable[[dict, dict], None], attempts: int = 3) -> Callable:
    """Function for ``mapInPandas``: render each row (``id``, ``payload`` JSON) with bounded retries.

    Output (id, result JSON, error, attempts): a failed row keeps the last error and its own last output.
    """
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, payload in zip(pdf["id"], pdf["payload"]):
                item, result, error, used = json.loads(payload), None, None, 0
                for used in range(1, attempts + 1):
                    result = error = None
                    try:
                        result = render({**item, "attempt": used})
                        check(item, result)
                        break
                    except (ValueError, OSError) as e:
                        error = str(e)
                rows.append((key, None if result is None else json.dumps(result, ensure_ascii=False, separators=(",", ":")), error, used))
            yield pd.DataFrame(rows, columns=["id", "result", "error", "attempts"])

    return run


RETRIED = "id string, result string, error string, attempts int"
