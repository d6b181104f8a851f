"""Stored benchmark results as tables. Their values are fixed: published figures, not measured here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: method, runtime_s, megapixels_per_s, ssim, psnr, precision, recall, f1, iou on the 1080p scene.
FULL_HD = [
    ("qhed", 0.183322, 11.311, 0.9905, 30.3389, 1.0000, 1.0000, 1.0000, 1.0000),
    ("sobel", 0.043179, 48.023, 0.9847, 26.3052, 0.9857, 1.0000, 0.9928, 0.4984),
    ("prewitt", 0.024046, 86.234, 0.9840, 25.9248, 0.9636, 1.0000, 0.9815, 0.4639),
    ("canny", 0.024584, 84.348, 0.9944, 30.3478, 1.0000, 0.9996, 0.9998, 0.7851),
    ("laplacian", 0.019112, 108.500, 0.9809, 26.6355, 0.9837, 0.9653, 0.9744, 0.4692),
]
#: width, height, method, runtime_s of the resolution sweep.
SWEEP = [
    (480, 270, "qhed", 0.032), (480, 270, "sobel", 0.004), (480, 270, "canny", 0.002),
    (960, 540, "qhed", 0.080), (960, 540, "sobel", 0.011), (960, 540, "canny", 0.011),
    (1920, 1080, "qhed", 0.277), (1920, 1080, "sobel", 0.059), (1920, 1080, "canny", 0.028),
    (3840, 2160, "qhed", 1.626), (3840, 2160, "sobel", 0.152), (3840, 2160, "canny", 0.176),
]
#: method, runtime_s, megapixels_per_s, ssim, psnr, precision, recall, f1, iou on the sample image, against Canny's edges; psnr 999: no difference.
SAMPLE = [
    ("qhed", 0.1431, 6.44, 0.1888, 23.62, 0.9996, 0.9996, 0.9996, 0.9992),
    ("sobel", 0.0233, 39.64, 0.2779, 24.48, 0.9997, 0.9997, 0.9997, 0.9994),
    ("prewitt", 0.0184, 50.19, 0.2889, 24.26, 0.9997, 0.9997, 0.9997, 0.9994),
    ("canny", 0.0130, 70.98, 1.0000, 999.0, 1.0000, 1.0000, 1.0000, 1.0000),
    ("laplacian", 0.0121, 75.99, 0.2251, 24.25, 0.9894, 0.9894, 0.9894, 0.9790),
]
#: Figures of the circuit check: the crop, its time, and a tile's circuit as stored (circuit.metrics gives those of this engine's gates).
CIRCUIT = {"max_abs_delta": 5.76e-12, "crop": "64x64", "elapsed_s": 11.98, "qubits_8x8": 7, "qubits_16x16": 9, "gates_8x8": 68, "depth_8x8": 24, "halo_px": 1, "linear_scaling_r2": 0.998}
#: Tiles that the sweep states for the quantum detector, by width.
SWEEP_TILES = {480: 2400, 960: 9600, 1920: 42420, 3840: 169641}
#: What a method is called and what kind it is.
LABELS = {
    "qhed": ("QHED (Simulated)", "Quantum (Simulated)"),
    "sobel": ("Sobel", "Classical (Spatial 3×3)"),
    "prewitt": ("Prewitt", "Classical (Spatial 3×3)"),
    "canny": ("Canny", "Classical (Multi-stage)"),
    "laplacian": ("Laplacian", "Classical (2nd Derivative)"),
}

COLUMNS = "method string, runtime_s double, megapixels_per_s double, ssim double, psnr double, precision double, recall double, f1 double, iou double"


def full_hd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FULL_HD, COLUMNS)


def sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE, COLUMNS)


def circuit_figures(spark: SparkSession) -> DataFrame:
    """(name, value) of CIRCUIT, values as text."""
    return spark.createDataFrame([(k, str(v)) for k, v in CIRCUIT.items()], "name string, value string")


def sweep(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SWEEP, "width int, height int, method string, runtime_s double")
