"""Settings of an edge-detection run, validated when made."""

from __future__ import annotations

import dataclasses
import math
import re
from enum import Enum

from pyspark.sql import SparkSession

#: Tile sizes that can be asked for.
TILE_SIZES = (4, 8, 16, 64, 128, 256, 512)
#: Tile sizes that a request may ask for.
REQUEST_TILES = (4, 8, 16)
#: Backends that simulate a circuit for each tile, and what their input is limited to.
CIRCUIT_BACKENDS, CIRCUIT_MAX_SIDE, CIRCUIT_TILE = ("circuit", "circuit-noisy", "hardware"), 64, 4


class Preset(Enum):
    """The longest side that an image keeps."""

    FAST = "fast"
    BALANCED = "balanced"
    FULL_4K = "full-4k"

    @property
    def max_side(self) -> int:
        return {"fast": 512, "balanced": 1280, "full-4k": 3840}[self.value]


class ExecutorKind(Enum):
    """How tiles are dealt out: in as many tasks as there are, or as ``workers`` says (threads and processes alike), or in one task."""

    THREAD = "thread"
    PROCESS = "process"
    SERIAL = "serial"


@dataclasses.dataclass(frozen=True)
class EdgeConfig:
    tile_size: int = 8
    preset: Preset = Preset.BALANCED
    backend: str = "exact"
    workers: int = 0
    batch_size: int = 0
    executor: ExecutorKind = ExecutorKind.THREAD
    shots: int | None = None
    seed: int | None = None
    threshold: float = 0.2

    def __post_init__(self) -> None:
        object.__setattr__(self, "preset", Preset(self.preset))
        object.__setattr__(self, "executor", ExecutorKind(self.executor))
        if self.tile_size not in TILE_SIZES:
            raise ValueError(f"tile_size must be one of {TILE_SIZES}, not {self.tile_size}")
        if self.workers < 0 or self.batch_size < 0:
            raise ValueError("workers and batch_size can't be negative")
        if self.shots is not None and self.shots < 1:
            raise ValueError("shots must be positive or None")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must lie in [0, 1]")

    def with_updates(self, **changes) -> EdgeConfig:
        """A validated copy."""
        return dataclasses.replace(self, **changes)

    def limited(self) -> tuple[EdgeConfig, int, str | None]:
        """(config, longest side, note): circuits get small images and tiles, with a note that says so."""
        if self.backend.lower() not in CIRCUIT_BACKENDS:
            return self, self.preset.max_side, None
        note = f"backend {self.backend!r} simulates a circuit for each tile: at most {CIRCUIT_MAX_SIDE} pixels a side, {CIRCUIT_TILE}x{CIRCUIT_TILE} tiles"
        return self.with_updates(tile_size=CIRCUIT_TILE), min(CIRCUIT_MAX_SIDE, self.preset.max_side), note


def request_config(payload: dict) -> EdgeConfig:
    """A config from the strings of a request: tile sizes other than REQUEST_TILES count as 8, shots only if they are digits."""
    shots, tile = str(payload.get("shots") or ""), int(payload.get("tile_size", 8))
    return EdgeConfig(
        tile_size=tile if tile in REQUEST_TILES else 8,
        backend=str(payload.get("backend", "exact")),
        threshold=float(payload.get("threshold", 0.2)),
        shots=int(shots) if shots.isdigit() else None,
    )


def suggested_settings(height: int, width: int, backend: str = "exact", memory: int = 4 << 30, cpus: int = 8) -> dict[str, int]:
    """Tile size, rows of an Arrow batch and partitions for an image of this size.

    Circuits: 4x4 tiles, 32 a batch, 4 tasks. Else 16x16 tiles above two megapixels and 8x8 below, and as many
    tiles a batch as fit 2 % of memory at 128 bytes a pixel, from 256 to 65,536 (4,096 at least for a GPU).
    """
    circuit, gpu = backend.lower() in CIRCUIT_BACKENDS, backend.lower() == "gpu"
    tile = 4 if circuit else 16 if height * width > 2_000_000 else 8
    batch = 32 if circuit else max(256, min(65_536, int(0.02 * memory / (tile * tile * 128))))
    batch = max(batch, 4_096) if gpu else batch
    tiles = math.ceil(height / (tile - 1)) * math.ceil(width / (tile - 1))
    tasks = max(1, min(min(cpus, 4) if circuit else cpus, math.ceil(tiles / batch)))
    return {"tile_size": tile, "batch_size": batch, "partitions": 1 if gpu else tasks}


#: Memory that is assumed where the session doesn't say, and the share of a JVM's memory that is left to Python there.
ASSUMED_MEMORY = 4 << 30


def _bytes(size: str) -> int:
    m = re.match(r"(\d+)\s*([kmgt]?)b?\Z", size.strip().lower())
    if not m:
        raise ValueError(f"not a size: {size!r}")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]]


def detected_resources(spark: SparkSession) -> dict[str, int]:
    """Memory of an executor, its cores and those of all executors, as far as the session knows."""
    conf, local = spark.sparkContext.getConf(), spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    memory = conf.get("spark.driver.memory" if local else "spark.executor.memory", None)
    total = spark.sparkContext.defaultParallelism
    cores = total if local else int(conf.get("spark.executor.cores", "1"))
    return {"memory": _bytes(memory) if memory else ASSUMED_MEMORY, "cores": cores, "total_cores": total}


def settings_for(spark: SparkSession, height: int, width: int, config: EdgeConfig | None = None) -> EdgeConfig:
    """``config`` with the batch size and number of tasks that the session's resources suggest, where it leaves them open."""
    config, found = config or EdgeConfig(), detected_resources(spark)
    fit = suggested_settings(height, width, config.backend, found["memory"] // max(1, found["cores"]), found["total_cores"])
    return config.with_updates(batch_size=config.batch_size or fit["batch_size"], workers=config.workers or fit["partitions"])
