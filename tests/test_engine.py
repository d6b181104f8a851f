import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.config import EdgeConfig, ExecutorKind, Preset, detected_resources, request_config, settings_for, suggested_settings
from tilewright.functions import arrays
from tilewright.operators import backends, canny, circuit, metrics, post, resample, stencils, strips, tiling
from tilewright.plans import detection, requests
from tilewright.sources import images, jpeg, png, results, synthetic
from tilewright.streaming import changed_tiles


def gradient(v):
    p = np.pad(v, ((0, 1), (0, 1)), mode="edge")
    return np.sqrt((v - p[:-1, 1:]) ** 2 + (v - p[1:, :-1]) ** 2)


def convolved(v, kernel):
    p = np.pad(v, 1, mode="edge")
    return sum(kernel[i, j] * p[i : i + v.shape[0], j : j + v.shape[1]] for i in range(3) for j in range(3))


@pytest.mark.parametrize("shape", [(1, 1), (2, 9), (15, 16), (37, 23)])
def test_tiled_equals_untiled(pixels_of, array_of, shape):
    v = np.random.default_rng(1).random(shape)
    px = pixels_of(v)
    assert np.allclose(array_of(stencils.qhed(px)), gradient(v), atol=1e-12)
    for t in (4, 8):
        tiles = tiling.split(px, t)
        assert tiles.count() == tiling.grid(*shape, t)["num_tiles"]
        assert np.array_equal(array_of(tiling.stitch(tiles.withColumn("core", tiling.core_of(F.col("px"), t)), t)), v)
        assert np.allclose(array_of(tiling.stitch(backends.run_tiles(tiles, t, backends.exact), t)), gradient(v), atol=1e-12)
        assert np.allclose(array_of(tiling.stitch(tiles.select("*", arrays.magnitude(F.col("px"), t).alias("core")), t)), gradient(v), atol=1e-12)
    assert np.allclose(array_of(strips.to_pixels(strips.qhed(strips.from_lines(px, 4)))), gradient(v), atol=1e-12)


def test_batches_cover_the_grid(pixels_of):
    tiles = tiling.split(pixels_of(np.random.default_rng(2).random((20, 17))), 4)
    assert sum(tiling.batch(tiles, k, k + 7).count() for k in range(0, 42, 7)) == 42
    with pytest.raises(ValueError):
        tiling.batch(tiles, 3, 2)
    with pytest.raises(ValueError):
        tiling.grid(3, 3, 1)


def test_detectors(pixels_of, array_of):
    v = np.random.default_rng(3).random((13, 17))
    px, k = pixels_of(v), np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    assert np.allclose(array_of(stencils.sobel(px)), np.hypot(convolved(v, k), convolved(v, k.T)))
    k = np.array([[-1, 0, 1]] * 3)
    assert np.allclose(array_of(stencils.prewitt(px)), np.hypot(convolved(v, k), convolved(v, k.T)))
    assert np.allclose(array_of(stencils.laplacian(px)), abs(convolved(v, np.array([[2, 0, 2], [0, -8, 0], [2, 0, 2]]))))
    flat = pixels_of(np.full((6, 5), 0.4))
    for f in stencils.DETECTORS.values():
        assert not array_of(post.normalise(f(flat))).any()


def test_canny(pixels_of, array_of):
    v = np.zeros((20, 24))
    v[5:15, 6:18] = 0.8
    m = array_of(canny.detect(pixels_of(v)))
    assert m.any() and not m[:3].any() and not m[8:12, 10:14].any() and set(np.unique(m)) == {0.0, 1.0}
    assert not canny.canny(np.full((9, 9), 0.5)).any()
    low, high = canny.auto_thresholds(0.0)
    assert (low, high) == (10, 20) and canny.auto_thresholds(200.0)[1] <= 255


def test_circuit_is_the_shift_and_the_fast_result():
    for n in (1, 2, 3, 4):
        state = np.eye(1 << n)
        for g in circuit.decrement_gates(n):
            state = circuit.apply(state, *g)
        assert np.array_equal(state, np.roll(np.eye(1 << n), -1, axis=1))
    tiles = np.random.default_rng(4).random((20, 4, 4))
    tiles[3] = 0
    run = backends.get("circuit")
    assert np.allclose(run(tiles, list(range(20))), backends.exact(tiles, []), atol=1e-8)
    assert np.allclose(circuit.differences(np.array([[1.0, 2, 4, 8]])), [[-1, -2, -4, 7]])
    shots = backends.get("circuit", EdgeConfig(shots=200_000, seed=11))
    assert np.allclose(shots(tiles, list(range(20))), backends.exact(tiles, []), atol=0.12)
    assert np.array_equal(shots(tiles[5:7], [5, 6]), shots(tiles, list(range(20)))[5:7])
    p = np.random.default_rng(5).random((3, 16))
    assert np.allclose(circuit.misread(p, 0.1).sum(axis=1), p.sum(axis=1)) and np.allclose(circuit.misread(p, 0.0), p)
    assert circuit.metrics(6) == {"num_qubits": 7, "depth": 9, "gate_count": 10} and len(circuit.gates(6)) == 10
    assert backends.get("circuit-noisy", EdgeConfig(seed=1))(tiles, list(range(20))).shape == (20, 3, 3)
    with pytest.raises(ValueError):
        circuit.prepared(np.ones((1, 4)))
    with pytest.raises(ValueError):
        circuit.differences(np.ones((1, 4)), shots=0)


@pytest.fixture
def registry(monkeypatch):
    """What a test registers is gone after it."""
    monkeypatch.setattr(backends, "_factories", dict(backends._factories))


def test_noise_is_what_random_errors_give_on_average():
    r = np.random.default_rng(12)
    amps = r.random((3, 8))
    amps /= np.sqrt((amps * amps).sum(axis=1, keepdims=True))
    assert np.allclose(circuit.noisy_probabilities(amps, 0.0), circuit.run(amps) ** 2)
    total = np.zeros((3, 16))
    for _ in range(3000):
        state = circuit.prepared(amps)
        for gate, controls, target in circuit.gates(3)[1:]:
            state = circuit.apply(state, gate, controls, target)
            if r.random() < (0.2 if controls else 0.1):
                for q in (*controls, target):
                    error = r.integers(4)
                    state = circuit.apply(state, "x", (), q) if error in (1, 2) else state
                    state = circuit.apply(state, "z", (), q) if error in (2, 3) else state
        total += state * state
    p = circuit.noisy_probabilities(amps, 0.1)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(total / 3000, p, atol=0.02)


def test_registry(registry, monkeypatch):
    with pytest.raises(ValueError):
        backends.register("EXACT", lambda c: backends.exact)
    with pytest.raises(ValueError, match="there are"):
        backends.get("none")
    for name in ("gpu", "hardware"):
        with pytest.raises(backends.NotAvailable):
            backends.get(name)
    backends.register("double", lambda c: lambda t, k: 2 * backends.exact(t, k))
    assert "double" in backends.available() and "double" not in backends.BUILT_IN
    said = set()
    for token, client in ((None, "json"), ("x", "no_such_module"), ("x", "json")):
        monkeypatch.setattr(backends, "CLIENT", client)
        monkeypatch.setenv(backends.TOKEN, token) if token else monkeypatch.delenv(backends.TOKEN, raising=False)
        with pytest.raises(backends.NotAvailable) as e:
            backends.get("hardware")
        said.add(str(e.value))
    assert len(said) == 3


def test_custom_backend_runs(registry, pixels_of, array_of):
    backends.register("double", lambda c: lambda t, k: 2 * backends.exact(t, k), overwrite=True)
    v = np.random.default_rng(6).random((9, 10))
    for settings in ({}, {"executor": ExecutorKind.SERIAL}, {"workers": 2, "batch_size": 3}):
        out = detection.magnitudes(pixels_of(v), EdgeConfig(backend="double", tile_size=4, **settings))
        assert np.allclose(array_of(out), 2 * gradient(v))
    assert detection.magnitudes(pixels_of(v), EdgeConfig(backend="double", tile_size=4, workers=1)).rdd.getNumPartitions() == 1
    sizes = []
    sized = lambda t, k: sizes.append(len(t)) or backends.exact(t, k)
    assert np.allclose(array_of(tiling.stitch(backends.run_tiles(tiling.split(pixels_of(v), 4), 4, sized, 3), 4)), gradient(v)) and not sizes  # in workers


def test_resources(spark):
    found = detected_resources(spark)
    assert found == {"memory": 4 << 30, "cores": 4, "total_cores": 4}
    config = settings_for(spark, 2160, 3840, EdgeConfig(workers=3))
    assert config.workers == 3 and config.batch_size == suggested_settings(2160, 3840, memory=1 << 30)["batch_size"]


def test_progress(spark):
    import threading

    told, done = [], threading.Event()
    df = detection.watched(spark.range(37), lambda n: (told.append(n), done.set()))
    assert df.count() == 37 and done.wait(30) and told == [37]


def test_strips_equal_columns(pixels_of, array_of):
    r = np.random.default_rng(13)
    for shape, rows in (((1, 1), 3), ((3, 5), 3), ((23, 31), 4), ((20, 9), 7)):
        v = np.clip(np.cumsum(r.normal(0, 0.15, shape), axis=1) + 0.5, 0, 1)
        px = pixels_of(v)
        cut = strips.from_lines(px, rows, 3)
        for method, f in stencils.DETECTORS.items():
            assert np.allclose(array_of(strips.to_pixels(strips.magnitudes(cut, method))), array_of(f(px)), atol=1e-12)
            counted = strips.detected_counts(cut, 0.3, method).first()
            m = array_of(f(px))
            assert counted.peak == pytest.approx(m.max()) and counted.n_edges == ((m >= 0.3 * m.max()).sum() if m.max() > 1e-9 else 0)
        for thresholds in ((None, None), (30.0, 200.0), (5.0, 300.0)):
            masks = strips.canny_masks(cut, *thresholds)
            want = canny.canny(v, *thresholds)
            assert np.array_equal(array_of(strips.canny_pixels(masks)) > 0, want)
            assert masks.groupBy().sum("open").first()[0] is not None and strips.canny_counts(masks).first().n_edges == want.sum()
    with pytest.raises(ValueError):
        strips.from_lines(px, 2, 3)


def test_canny_spreads_over_many_strips(pixels_of, array_of):
    v = np.zeros((40, 40))
    v[4:36, 4:36] = np.linspace(0.12, 0.9, 32)[:, None]  # weak at the top, strong at the bottom
    want = canny.canny(v, 100.0, 700.0)
    assert want[6:, 3:5].any() and not np.array_equal(want, canny.canny(v, 699.0, 700.0))
    assert np.array_equal(array_of(strips.canny_pixels(strips.canny_masks(strips.from_lines(pixels_of(v), 4, 3), 100.0, 700.0))) > 0, want)


def test_resize(pixels_of, array_of):
    v = np.random.default_rng(7).random((30, 60))
    small = array_of(resample.resize(pixels_of(v), 30, 60, 20), "v")
    assert small.shape == (10, 20) and np.allclose(small, v.reshape(10, 3, 20, 3).mean(axis=(1, 3)))
    px = pixels_of(v)
    assert resample.resize(px, 30, 60, 60) is px
    assert resample.target_size(5, 2, 1) == (1, 1) and resample.target_size(1080, 1920, 1280) == (720, 1280)
    odd = np.random.default_rng(8).random((23, 31))
    assert abs(array_of(resample.resize(pixels_of(odd), 23, 31, 10), "v").mean() - odd.mean()) < 1e-12


def mask(pixels_of, m):
    return pixels_of(m.astype(float)).withColumn("e", F.col("v") > 0)


def test_metrics(pixels_of):
    zero, tenth = pixels_of(np.zeros((10, 10))), pixels_of(np.full((10, 10), 0.1))
    assert abs(metrics.psnr(metrics.aligned(zero, tenth, "v")).first().psnr - 20) < 1e-9
    assert metrics.psnr(metrics.aligned(zero, zero, "v")).first().psnr == float("inf")
    assert metrics.ssim(metrics.aligned(tenth, tenth, "v")).first().ssim == pytest.approx(1)
    two = pixels_of(np.eye(2))
    assert metrics.ssim(metrics.aligned(two, two, "v")).first().ssim == 1 and metrics.ssim(metrics.aligned(two, pixels_of(np.zeros((2, 2))), "v")).first().ssim == 0
    line = np.zeros((20, 20), dtype=bool)
    line[:, 10] = True
    a, b = mask(pixels_of, line), mask(pixels_of, np.roll(line, 1, axis=1))
    assert metrics.edge_scores(a, b, 0).first().f1 == 0 and metrics.edge_scores(a, b, 1).first().f1 == 1
    none = mask(pixels_of, np.zeros((20, 20), dtype=bool))
    assert tuple(metrics.edge_scores(none, none).first())[1:] == (1, 1, 1) and tuple(metrics.edge_scores(a, none).first())[1:] == (0, 0, 0)
    assert metrics.iou(none, none).first().iou == 1 and metrics.iou(a, b).first().iou == 0 and metrics.edge_density(a).first().edge_density == 0.05
    for other in (pixels_of(np.zeros((10, 11))), zero.where("y > 0"), pixels_of(np.zeros((10, 10)), "b")):
        with pytest.raises(Exception, match="differ in size"):
            metrics.psnr(metrics.aligned(zero, other, "v")).collect()
        with pytest.raises(Exception, match="differ in size"):
            post.signed_difference(*(x.withColumnRenamed("v", "m") for x in (zero, other))).collect()


def test_scene_edges_are_found(spark, array_of):
    s = synthetic.scene(spark, 48, 64)
    truth = stencils.label_edges(s)
    found = detection.run(s.select("image_id", "h", "w", "y", "x", "v"), 48, 64, EdgeConfig(preset=Preset.FULL_4K, threshold=0.0))
    assert np.array_equal(array_of(found, "e"), array_of(truth, "e"))
    assert np.array_equal(array_of(strips.to_pixels(strips.scene(spark, 48, 64, 10))), array_of(s, "v"))
    counted = strips.edge_counts(strips.qhed(strips.scene(spark, 48, 64, 10)), 0.2).first()
    m = gradient(array_of(s, "v"))
    assert counted.n_edges == (m >= 0.2 * m.max()).sum() and counted.peak == m.max()
    assert synthetic.sample(spark, 16, 16).select("v").collect() == synthetic.sample(spark, 16, 16).repartition(7).orderBy("y", "x").select("v").collect()


def test_benchmark(spark):
    s = synthetic.scene(spark, 24, 32)
    rows = detection.scaling(spark, ((24, 32),), ("qhed", "sobel"))
    assert rows.columns[3:] == list(detection.COLUMNS)
    got = {r.method: r for r in rows.collect()}
    assert got["qhed"].f1 == 1 and got["qhed"].iou == 1 and got["sobel"].tiles_per_s is None and got["sobel"].ssim < 1
    with pytest.raises(ValueError, match="unknown method"):
        detection.detect(s, "none", EdgeConfig())


def colour_png(samples, colour, depth=8, extra=b"", interlaced=0, filters=(0, 1, 2, 3, 4)):
    """A PNG of samples (h, w, c) that uses the filters in turn."""
    h, w, c = samples.shape
    step = c * depth // 8
    lines = samples.astype(">u2" if depth == 16 else np.uint8).reshape(h, -1).view(np.uint8).astype(int)
    raw, before = b"", np.zeros(lines.shape[1], dtype=int)
    for k, line in enumerate(lines):
        kind = filters[k % len(filters)]
        left = np.concatenate([np.zeros(step, int), line[:-step]])
        corner = np.concatenate([np.zeros(step, int), before[:-step]])
        p = left + before - corner
        nearest = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [0, left, before, (left + before) // 2, nearest][kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        before = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png():
    r = np.random.default_rng(9)
    for colour, c in ((0, 1), (2, 3), (4, 2), (6, 4)):
        for depth in (8, 16):
            s = r.integers(0, 1 << depth, (11, 7, c))
            got, top = png.decode(colour_png(s, colour, depth))
            assert top == (1 << depth) - 1 and np.array_equal(got, s)
    grey = r.integers(0, 256, (5, 9)).astype(np.uint8)
    assert np.array_equal(png.decode(png.encode(grey))[0][..., 0], grey) and np.allclose(png.grey(png.encode(grey)) * 255, grey)
    assert png.grey(colour_png(np.full((2, 2, 1), 32768), 0, 16))[0, 0] == 32768 / 65535
    assert png.grey(colour_png(np.zeros((2, 2, 4), int), 6))[0, 0] == 1.0  # clear black over white
    for bad in (b"", b"x" * 50, png.encode(grey)[:-9], png.encode(grey)[:40] + b"??" + png.encode(grey)[42:]):
        with pytest.raises(png.ImageError):
            png.decode(bad)


def test_jpeg():
    r = np.random.default_rng(14)
    for shape in ((8, 8), (1, 1), (37, 53)):
        v = np.clip(np.cumsum(r.normal(0, 3, shape), axis=1) + 120, 0, 255).astype(np.uint8)
        data = jpeg.encode_grey(v, 1, 6)
        assert np.abs(jpeg.decode(data)[..., 0].astype(int) - v).max() <= 1 and jpeg.size(data) == shape[::-1] and jpeg.orientation(data) == 6
        assert images.grey(data).shape == shape[::-1] and images.check(data)[3] in (None, "smaller than 2 pixels")
    for bad in (b"", b"\xff\xd8", data[: len(data) // 2], data[:300], b"\xff\xd8\xff\xd9"):
        with pytest.raises(jpeg.ImageError):
            jpeg.decode(bad)
    assert images.check(data[: len(data) // 2])[3] == "truncated or damaged"


def test_jpeg_equals_the_jvm_decoder(spark, tmp_path):
    """Sequential and progressive colour files that the JVM writes, at full and at half the chroma."""
    jvm, r = spark._jvm, np.random.default_rng(15)
    h, w = 45, 62
    base = np.clip(np.cumsum(np.cumsum(r.normal(0, 1.5, (h, w, 3)), axis=0), axis=1) / 4 + 128, 0, 255).astype(int)
    made = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            made.setRGB(x, y, int(base[y, x, 0] << 16 | base[y, x, 1] << 8 | base[y, x, 2]))
    for progressive in (False, True):
        path = str(tmp_path / f"{progressive}.jpg")
        writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
        param = writer.getDefaultWriteParam()
        if progressive:
            param.setProgressiveMode(1)
        out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(path))
        writer.setOutput(out)
        writer.write(None, jvm.javax.imageio.IIOImage(made, None, None), param)
        out.close()
        data = open(path, "rb").read()
        assert any(kind == (0xC2 if progressive else 0xC0) for kind, _, _ in jpeg.segments(data))
        row = spark.read.format("image").load(path).select("image.*").first()
        want = np.frombuffer(row.data, np.uint8).reshape(h, w, 3)[..., ::-1].astype(int)
        assert np.abs(jpeg.decode(data).astype(int) - want).max() <= 4


def test_png_files_and_sample(spark, tmp_path, pixels_of, array_of):
    v = np.random.default_rng(16).integers(0, 256, (5, 7)).astype(np.uint8)
    px = pixels_of(v / 255.0, "a/b.jpeg")
    written = images.write_png_files(px, f"file://{tmp_path}/out", "v").collect()
    assert [r.path.rsplit("/", 1)[1] for r in written] == ["a_b_qhed_edges.png"] and [p.name for p in (tmp_path / "out").iterdir()] == ["a_b_qhed_edges.png"]
    assert np.array_equal(png.decode((tmp_path / "out/a_b_qhed_edges.png").read_bytes())[0][..., 0], v)
    found = images.sample_or_scene(spark, str(tmp_path / "out/a_b_qhed_edges.png"))
    assert np.allclose(array_of(found, "v") * 255, v)
    assert images.sample_or_scene(spark, str(tmp_path / "none.png")).count() == images.sample_or_scene(spark).count() == 540 * 960
    assert len(results.SAMPLE) == 5


def test_files(spark, tmp_path, array_of):
    v = np.random.default_rng(10).integers(0, 256, (6, 8)).astype(np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(png.encode(v))
    (tmp_path / "in/b.png").write_bytes(b"no image")
    files = images.read(spark, str(tmp_path / "in"))
    errors = {r.image_id: r.error for r in images.validate(files).collect()}
    assert errors == {"a.png": None, "b.png": "not a readable PNG or JPEG image"}
    px = images.decode(files.where("image_id = 'a.png'"))
    assert np.allclose(array_of(px, "v") * 255, v)
    assert np.allclose(array_of(images.read_8bit(spark, str(tmp_path / "in/a.png")), "v") * 255, v)
    images.write_png(px, str(tmp_path / "out"), "v")
    assert np.array_equal(png.decode(spark.read.parquet(str(tmp_path / "out")).first().content)[0][..., 0], v)
    url = images.to_png(px, "v").select(images.data_url(F.col("content")).alias("u"))
    assert url.select(images.content_of(F.col("u")).alias("c")).first().c == png.encode(v)


def test_config():
    for bad in ({"tile_size": 5}, {"workers": -1}, {"batch_size": -2}, {"shots": 0}, {"threshold": 1.5}, {"preset": "ultra"}):
        with pytest.raises(ValueError):
            EdgeConfig(**bad)
    assert EdgeConfig().with_updates(tile_size=16).tile_size == 16
    config, side, note = EdgeConfig(backend="circuit").limited()
    assert (config.tile_size, side) == (4, 64) and note and EdgeConfig().limited()[2] is None
    assert request_config({"shots": "x"}).shots is None and request_config({"shots": "12"}).shots == 12 and request_config({"tile_size": 5}).tile_size == 8
    assert suggested_settings(2160, 3840)["tile_size"] == 16 and suggested_settings(64, 64, "circuit")["batch_size"] == 32


def test_array_functions(spark):
    v = np.random.default_rng(11).random(16)
    df = spark.createDataFrame([(v.tolist(), [0.0] * 16)], "c array<double>, z array<double>")
    amps = arrays.amplitudes(F.col("c"))
    r = df.select(
        arrays.differences_from_state(arrays.statevector(amps["amps"]), amps["norm"]).alias("a"), arrays.cyclic_differences(F.col("c")).alias("b"), arrays.amplitudes(F.col("z")).alias("z"),
        arrays.transposed(F.col("c"), 4).alias("t"), arrays.next_power_of_two(F.lit(17)).alias("p"), arrays.coordinates_of(F.lit(7), 3, 4).alias("yx"), arrays.index_of(F.lit(1), F.lit(3), 3, 4).alias("k"),
    ).first()
    assert np.allclose(r.a, v - np.roll(v, -1)) and np.allclose(r.b, r.a) and r.z.norm == 0 and not any(r.z.amps)
    assert np.allclose(r.t, v.reshape(4, 4).T.reshape(-1)) and (r.p, r.yx.y, r.yx.x, r.k) == (32, 1, 3, 7)
    with pytest.raises(Exception, match="power of two"):
        df.select(arrays.data_qubits(F.lit(12))).collect()


def test_changed_tiles(spark, tmp_path):
    tiles = lambda f, v: [("s", k, f, [v[k]] * 4) for k in range(2)]
    for f, v in enumerate(([1.0, 2.0], [1.0, 3.0], [1.0, 3.0])):
        spark.createDataFrame(tiles(f, v), changed_tiles.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(changed_tiles.SCHEMA).parquet(str(tmp_path / "in"))
    q = changed_tiles.changed(stream).writeStream.format("memory").queryName("changed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.tile_id, r.frame) for r in spark.table("changed").collect()) == [(0, 0), (1, 0), (1, 1)]


def test_requests(spark):
    import base64
    import json

    v = np.kron(np.eye(4), np.ones((5, 6))) * 200
    body = {"image_b64": "data:image/png;base64," + base64.b64encode(png.encode(v.astype(np.uint8))).decode(), "tile_size": 5}
    ask = lambda verb, route, payload=None: (lambda a: (a[0], json.loads(a[1] or "null")))(requests.answer(spark, verb, route, payload and json.dumps(payload)))
    assert {b["name"] for b in ask("GET", "/api/capabilities")[1]["backends"]} >= set(backends.BUILT_IN)
    assert len(ask("get", "/api/benchmarks_baseline")[1]["sample"]) == 5 and ask("GET", "/nothing") == (404, None)
    status, got = ask("POST", "/api/process", body)
    assert status == 200 and (got["metadata"]["width"], got["metadata"]["height"], got["metadata"]["tiles"], got["metadata"]["qubits"]) == (24, 20, 12, 7)
    m = gradient(v / 255)
    shown = png.decode(base64.b64decode(got["qhed"].split(",")[1]))[0][..., 0]
    assert np.array_equal(shown, png.levels(m / m.max())) and set(got["tile_stages"]) == {"original", "normalised", "amplitudes", "across", "down", "magnitude", "edges", "circuit"}
    status, got = ask("POST", "/api/benchmark", {"use_synthetic": True, "height": 24, "width": 32, "methods": ["sobel", "qhed"]})
    assert status == 200 and [r["method"] for r in got["results"]] == ["sobel", "qhed"] and got["results"][1]["label"] == "QHED (Simulated)" and got["summary"]["highest_f1_method"] == "qhed" and got["reference"] == "truth"
    status, got = ask("POST", "/api/scaling", {"sizes": [[16, 24], [8, 8]], "methods": ["qhed"]})
    assert status == 200 and [r["resolution"] for r in got["pivot_rows"]] == ["8x8", "24x16"] and len(got["sweep_records"]) == 2
    assert ask("POST", "/api/process", {"image_b64": "bm8="}) == (500, {"status": "error", "message": "not a readable PNG or JPEG image"})
