"""An extension: of a stream of frames cut into tiles, those that differ from the last ones at their place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "stream_id string, tile_id int, frame long, px array<double>"


def changed(tiles: DataFrame) -> DataFrame:
    """(stream_id, tile_id, frame, hash) of the tiles whose hash is new at their place; state is one hash for each place.

    ``tiles`` is a stream of SCHEMA. Frames of a batch are taken in order.
    """
    hashed = tiles.select("stream_id", "tile_id", "frame", F.xxhash64("px").alias("hash"))

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("frame")
        out = []
        for frame, value in zip(rows["frame"], rows["hash"], strict=True):
            if value != last:
                out.append((key[0], key[1], frame, value))
                last = value
        state.update((int(last),))
        yield pd.DataFrame(out, columns=["stream_id", "tile_id", "frame", "hash"])

    return hashed.groupBy("stream_id", "tile_id").applyInPandasWithState(
        update, "stream_id string, tile_id int, frame long, hash long", "hash long", "append", "NoTimeout"
    )
