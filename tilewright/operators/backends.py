"""Backends: functions from tiles to cores, registered by name and run in Arrow batches."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import EdgeConfig
from . import circuit

#: A backend takes tiles (B, T, T) and a key for each, and gives cores (B, T-1, T-1).
Backend = Callable[[np.ndarray, list], np.ndarray]


class NotAvailable(RuntimeError):
    """A backend that this installation can't run."""


_factories: dict[str, Callable[[EdgeConfig], Backend]] = {}


def register(name: str, factory: Callable[[EdgeConfig], Backend], overwrite: bool = False) -> None:
    if name.lower() in _factories and not overwrite:
        raise ValueError(f"backend {name!r} is registered already")
    _factories[name.lower()] = factory


def available() -> list[str]:
    return sorted(_factories)


def get(name: str, config: EdgeConfig | None = None) -> Backend:
    try:
        factory = _factories[name.lower()]
    except KeyError:
        raise ValueError(f"unknown backend {name!r}; there are {', '.join(available())}") from None
    return factory(config or EdgeConfig())


def exact(tiles: np.ndarray, keys: list) -> np.ndarray:
    """The statevector's result without the doubled state."""
    h, v = tiles[:, :-1, :-1] - tiles[:, :-1, 1:], tiles[:, :-1, :-1] - tiles[:, 1:, :-1]
    return np.sqrt(h * h + v * v)


def _circuit(shots: int | None, seed: int | None, noisy: bool) -> Backend:
    def run(tiles: np.ndarray, keys: list) -> np.ndarray:
        of = lambda flat, side: circuit.differences(flat, [(k, side) for k in keys], shots, seed, noisy)
        return circuit.magnitude(*circuit.oriented(tiles, of))

    return run


def _gpu(config: EdgeConfig) -> Backend:
    raise NotAvailable("a CUDA device isn't available on this cluster")


#: Where the hardware backend looks for its access token, and the client library that it would use.
TOKEN, CLIENT = "TILEWRIGHT_HARDWARE_TOKEN", "qiskit_ibm_runtime"


def _hardware(config: EdgeConfig) -> Backend:
    """Never runs: says whether the token or the client is missing, or that live runs are switched off."""
    if not os.environ.get(TOKEN):
        raise NotAvailable(f"a quantum processor isn't configured: set {TOKEN}, or use a simulated backend")
    if importlib.util.find_spec(CLIENT) is None:
        raise NotAvailable(f"a quantum processor can't be reached: {CLIENT} isn't installed")
    raise NotAvailable("a quantum processor is configured, but live runs are switched off")


register("exact", lambda c: exact)
register("circuit", lambda c: _circuit(c.shots, c.seed, False))
register("circuit-noisy", lambda c: _circuit(c.shots, c.seed, True))
register("gpu", _gpu)
register("hardware", _hardware)
BUILT_IN = tuple(available())


def capabilities(names: tuple[str, ...] | None = None) -> list[tuple[str, bool, str]]:
    """(backend, usable, reason) of all that are registered, or of ``names``."""
    out = []
    for name in available() if names is None else names:
        try:
            get(name)
            out.append((name, True, ""))
        except NotAvailable as e:
            out.append((name, False, str(e)))
    return out


def run_tiles(tiles: DataFrame, t: int, backend: Backend, batch_size: int = 0) -> DataFrame:
    """tiles(image_id, h, w, tile_id, px) to cores(image_id, h, w, tile_id, core): a narrow map of Arrow batches, cut to ``batch_size`` tiles if it isn't 0."""

    def cut(batches):
        for batch in batches:
            step = batch_size or max(1, batch.num_rows)
            yield from (batch.slice(k, step) for k in range(0, batch.num_rows, step))

    def run(batches):
        for batch in cut(batches):
            px = np.asarray(batch.column(4).flatten()).reshape(-1, t, t)
            keys = list(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True))
            cores = np.ascontiguousarray(backend(px, keys), dtype=np.float64)
            if cores.shape != (len(px), t - 1, t - 1):
                raise ValueError(f"a backend must give cores of {(len(px), t - 1, t - 1)}, not {cores.shape}")
            offsets = pa.array(np.arange(0, (len(px) + 1) * (t - 1) ** 2, (t - 1) ** 2, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.ListArray.from_arrays(offsets, pa.array(cores.reshape(-1)))], ["image_id", "h", "w", "tile_id", "core"])

    return tiles.select("image_id", "h", "w", "tile_id", "px").mapInArrow(run, "image_id string, h int, w int, tile_id int, core array<double>")
