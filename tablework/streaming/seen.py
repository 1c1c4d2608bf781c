"""Each message once by a whole-number id, with the ids seen kept as intervals or bitmaps of id ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids of a lane that share one state: 2^16. So places in a range are 16-bit numbers.
RANGE_BITS = 16
#: Above so many intervals (four bytes each) a bitmap of the range (8 KB) is the smaller state.
MOST_INTERVALS = (1 << RANGE_BITS) // 8 // 4


def _members(state: bytes) -> np.ndarray:
    """Which places of a range were seen, from its state: a bitmap, or the first and last places of intervals."""
    if len(state) == (1 << RANGE_BITS) // 8:
        return np.unpackbits(np.frombuffer(state, np.uint8)).astype(bool)
    edges = np.zeros((1 << RANGE_BITS) + 1, np.int32)
    first, last = np.frombuffer(state, "<u2").reshape(-1, 2).astype(np.int64).T
    edges[first] += 1
    edges[last + 1] -= 1
    return np.cumsum(edges)[:-1] > 0


def _state(members: np.ndarray) -> bytes:
    """The smaller of the two forms."""
    edges = np.diff(np.concatenate([[False], members, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    if len(first) >= MOST_INTERVALS:
        return np.packbits(members).tobytes()
    return np.stack([first, last], axis=1).astype("<u2").tobytes()


def deliver_once(stream: DataFrame, id: str = "id", lanes: int = 64) -> DataFrame:
    """Each id once: the first message that comes with it; later ones are dropped, however late. Nothing else is.

    ``id`` is a column of whole numbers. Ids are dealt over ``lanes`` by their remainder, so that new ones, which
    come in order, keep that many tasks busy; within a lane 2^16 consecutive quotients share one state. It holds the ids seen
    as sorted intervals, so ids that leave no gaps take a few numbers for 65,536 of them, or as a bitmap of 8 KB where there are
    many gaps. So state is a row a range, never one an id, and at most 8 KB. Messages without an id can't be told apart
    and all pass. ``lanes`` belongs to the checkpoint and can't be changed later.
    """
    if not isinstance(stream.schema[id].dataType, T.IntegralType):
        raise ValueError(f"{id} must be a column of whole numbers")
    if lanes < 1:
        raise ValueError("lanes must be 1 or more")
    number = F.col(f"`{id}`").cast("decimal(20,0)")
    quotient = F.floor(number / lanes).cast("long")
    keys = {"_lane": F.pmod(F.col(f"`{id}`").cast("long"), F.lit(lanes)).cast("int"),
            "_range": F.shiftright(quotient, RANGE_BITS), "_place": F.pmod(quotient, F.lit(1 << RANGE_BITS)).cast("int")}
    names = stream.columns

    def fresh(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if key[0] is None or np.isnan(key[0]):
            for pdf in batches:
                yield pdf[names]
            return
        members = _members(state.get[0]) if state.exists else np.zeros(1 << RANGE_BITS, bool)
        for pdf in batches:
            new = pdf[~members[pdf["_place"].to_numpy()] & ~pdf["_place"].duplicated().to_numpy()]
            members[new["_place"].to_numpy()] = True
            if len(new):
                yield new[names]
        state.update((_state(members),))

    laid = stream.withColumns(keys)
    return laid.groupBy("_lane", "_range").applyInPandasWithState(fresh, stream.schema, "seen binary", "append", "NoTimeout")
