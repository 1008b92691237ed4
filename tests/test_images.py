import colorsys

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackpool.functions import pixels as X
from stackpool.functions.draws import uniform, uniforms
from stackpool.operators import images as I
from stackpool.queries.files import png
from stackpool.sources.images import list_files, scan_images


def mesh(h, w, c=3):
    return np.add.outer(np.arange(h), np.arange(w)).astype(float)[..., None].repeat(c, 2)


def table(spark, pics):
    rows = [(k, *v.shape, bytearray(v.astype(np.uint8).tobytes())) for k, v in pics.items()]
    return spark.createDataFrame(rows, "image string, height int, width int, channels int, data binary")


def arrays(df):
    return {r["image"]: np.array(r["pixels"]).reshape(r["height"], r["width"], r["channels"]) for r in df.collect()}


def test_decoding_png_jpeg_bmp_and_a_broken_file(spark, tmp_path):
    rgb = np.array([[[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [255, 255, 255]]], np.uint8)
    (tmp_path / "four.png").write_bytes(png(rgb.tobytes(), 2, 2))
    (tmp_path / "grey.png").write_bytes(png(bytes(range(64)), 8, 8, 1))
    (tmp_path / "broken.jpg").write_bytes(b"not a picture")
    jvm = spark._jvm
    for ext in ("jpg", "bmp"):
        img = jvm.java.awt.image.BufferedImage(8, 8, 1)
        for y in range(8):
            for x in range(8):
                img.setRGB(x, y, 0x204060)
        jvm.javax.imageio.ImageIO.write(img, ext, jvm.java.io.File(str(tmp_path / f"flat_{ext}.{ext}")))
    pics, rejects = scan_images(spark, str(tmp_path))
    got = arrays(I.apply(pics, lambda i, r: i, scale=1.0, dtype="double"))
    assert (got["four"] == rgb).all() and sorted(got) == ["flat_bmp", "flat_jpg", "four"]
    assert (got["flat_bmp"] == [0x20, 0x40, 0x60]).all() and np.abs(got["flat_jpg"] - [0x20, 0x40, 0x60]).max() <= 4
    assert {tuple(r) for r in rejects.collect()} == {("broken", "undecodable"), ("grey", "channels")}
    assert {r["image"] for r in list_files(spark, str(tmp_path), "*.png").collect()} == {"four", "grey"}


@pytest.mark.parametrize("method", X.RESIZE_METHODS)
def test_resize_keeps_flat_pictures_flat_and_equal_sizes_unchanged(method):
    assert np.allclose(X.resize(np.full((7, 5, 3), 0.3), 4, 9, method), 0.3)
    img = np.random.default_rng(0).random((6, 4, 3))
    assert np.allclose(X.resize(img, 6, 4, method), img)


def test_bilinear_has_no_half_pixel_shift():
    img = np.arange(4.0).reshape(1, 4, 1)
    assert X.resize(img, 1, 8, "bilinear").ravel().tolist() == [0, 0.5, 1, 1.5, 2, 2.5, 3, 3]
    assert X.resize(img, 1, 2, "nearest").ravel().tolist() == [0, 2]
    assert X.resize(img, 1, 2, "area").ravel().tolist() == [0.5, 2.5]
    assert np.allclose(X.resize(mesh(4, 4, 1), 2, 2, "area").ravel(), [1, 3, 3, 5])


def test_bilinear_matches_a_loop():
    img = np.random.default_rng(1).random((5, 7, 2))
    out = X.resize(img, 3, 11)
    for y in range(3):
        for x in range(11):
            sy, sx = y * 5 / 3, x * 7 / 11
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, 4), min(x0 + 1, 6)
            top = img[y0, x0] * (1 - (sx - x0)) + img[y0, x1] * (sx - x0)
            low = img[y1, x0] * (1 - (sx - x0)) + img[y1, x1] * (sx - x0)
            assert np.allclose(out[y, x], top * (1 - (sy - y0)) + low * (sy - y0))


def test_hsv_matches_the_standard_library():
    rgb = np.random.default_rng(2).random((6, 6, 3))
    rgb[0, 0] = 0.5
    rgb[0, 1] = 0
    hsv = X.to_hsv(rgb)
    for y in range(6):
        for x in range(6):
            assert np.allclose(hsv[y, x], colorsys.rgb_to_hsv(*rgb[y, x]))
    assert np.allclose(X.to_rgb(hsv), rgb)


@pytest.mark.parametrize("order", range(4))
@pytest.mark.parametrize("fast", [True, False])
def test_color_distortion_stays_in_range(order, fast):
    img = np.random.default_rng(3).random((5, 5, 3))
    out = X.distort_color(img, order, (0.9, 0.1, 0.7, 0.3), fast)
    assert out.min() >= 0 and out.max() <= 1 and not np.allclose(out, img)
    # middle draws change nothing
    assert np.allclose(X.distort_color(img, order, (0.5, 0.5, 0.5, 0.5), fast), img)


def test_hue_and_contrast_match_plain_arithmetic():
    img = np.random.default_rng(4).random((3, 3, 3)) * 0.4 + 0.3
    out = X.distort_color(img, 3, (0.5, 0.5, 0.8, 0.25), fast=False)
    want = np.array([[colorsys.hsv_to_rgb((h + 0.6 * 0.2) % 1, s, v) for h, s, v in (colorsys.rgb_to_hsv(*p) for p in row)] for row in img])
    mean = want.mean((0, 1))
    assert np.allclose(out, np.clip((want - mean) * 0.75 + mean, 0, 1))


def test_normalisations():
    img = np.random.default_rng(5).random((4, 6, 3))
    assert np.allclose(X.normalise(img, 0), img * 2 - 1)
    assert np.allclose(X.normalise(img, 1).mean((0, 1)), 0)
    z = X.normalise(img, 2)
    assert abs(z.mean()) < 1e-12 and abs(z.std() - 0.4) < 1e-12
    assert np.allclose(X.normalise(np.full((4, 4, 3), 0.7), 2), 0)
    with pytest.raises(ValueError):
        X.normalise(img, 3)


def test_crops_and_their_checks():
    img = mesh(8, 6)
    assert X.central_fraction(img, 0.5).shape == (4, 4, 3) and X.central_fraction(img).shape == (8, 6, 3)
    assert X.central_crop([img], 3, 3)[0][0, 0, 0] == 3
    a, b = X.offset_crop([img, img * 2], 4, 4, (0.99, 0.5))
    assert (a * 2 == b).all() and a[0, 0, 0] == 4 + 1
    for call in (lambda: X.crop(img, 0, 0, 9, 2), lambda: X.offset_crop([], 1, 1, (0, 0)), lambda: X.crop(img[..., 0], 0, 0, 1, 1),
                 lambda: X.offset_crop([img, mesh(7, 6)], 2, 2, (0, 0)), lambda: X.subtract_means(img[..., :2]),
                 lambda: X.central_fraction(img, 1.5), lambda: X.distort_color(img, 4, (0, 0, 0, 0)), lambda: X.axis_taps(3, 3, "cubic")):
        with pytest.raises(ValueError):
            call()


def test_sampled_windows_obey_the_limits():
    found = [X.sample_box(60, 90, lambda a, k=k: uniforms(7, k, a), area=(0.2, 1.0)) for k in range(200)]
    for t, l, h, w in found:
        assert 0 <= t <= 60 - h and 0 <= l <= 90 - w
        if (h, w) != (60, 90):
            assert 0.18 <= h * w / 5400 <= 1 and 0.7 <= w / h <= 1.4
    assert len(set(found)) > 150
    # a box that cannot be covered gives the whole picture
    assert X.sample_box(60, 90, lambda a: (0.0, 0.5, 0.99, 0.99), boxes=[(0, 0, 0.1, 0.1)], area=(0.01, 0.01)) == (0, 0, 60, 90)


def test_aspect_sizes():
    assert X.aspect_size(100, 300, 256) == (256, 768)
    assert min(X.aspect_size(333, 777, 256)) in (255, 256)


def test_box_outline():
    out = X.draw_box(np.zeros((5, 5, 3)), (0.0, 0.0, 1.0, 1.0))
    assert out[..., 0].sum() == 16 and out[..., 2].sum() == 0 and out[2, 2].sum() == 0


def test_draws_agree_between_columns_and_python(spark):
    row = spark.range(1).select(*[uniform(3, F.lit("img"), F.lit(2), F.lit("x"), word=w).alias(f"u{w}") for w in range(4)]).first()
    assert tuple(row) == uniforms(3, "img", 2, "x")


def test_replicas_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(6)
    pics = {f"p{i}": rng.integers(0, 256, (12, 10, 3)) for i in range(7)}

    def run(n):
        df = I.replicas(table(spark, pics).repartition(n), "dermatologic", 6, 6, 4, seed=5, fast=False)
        return {(r["image"], r["replica"]): tuple(r["pixels"]) for r in df.collect()}
    one = run(1)
    assert len(one) == 28 and one == run(5) and len(set(one.values())) == 28


def test_one_replica_takes_the_evaluation_form(spark):
    pics = {"a": np.random.default_rng(8).integers(0, 256, (12, 10, 3))}
    a = arrays(I.replicas(table(spark, pics), "inception", 6, 6, 1))["a"]
    b = arrays(I.treat(table(spark, pics), "inception", 6, 6, False))["a"]
    assert (a == b).all()


def test_side_treatment(spark):
    pics = {"a": np.random.default_rng(9).integers(0, 256, (30, 40, 3))}
    ev = arrays(I.treat(table(spark, pics), "vgg", 8, 8, False, side_min=10, dtype="double"))["a"]
    want = X.resize(pics["a"].astype(float), 10, 13)[1:9, 2:10] - X.CHANNEL_MEANS
    assert np.allclose(ev, want)
    assert arrays(I.treat(table(spark, pics), "vgg", 8, 8, True, side_min=10, side_max=12))["a"].shape == (8, 8, 3)


def test_treatments_refuse_what_they_do_not_know(spark):
    df = table(spark, {"a": mesh(4, 4)})
    for call in (lambda: I.treat(df, "lenet", 2, 2, False), lambda: I.treat(df, "vgg", 2, 2, False, normalise=1),
                 lambda: I.treat(df, "inception", 2, 2, True, area=(0.1, 1.0)), lambda: I.treat(df, "dermatologic", 2, 2, True, normalise=5),
                 lambda: I.replicas(df, "vgg", 2, 2, 0), lambda: I.resize(df, 2, 2, "lanczos"), lambda: I.normalise(df, 9)):
        with pytest.raises(ValueError):
            call()


def test_scoring_in_one_crossing_equals_scoring_stored_pixels(spark):
    rng = np.random.default_rng(10)
    df = table(spark, {f"p{i}": rng.integers(0, 256, (9, 11, 3)) for i in range(5)})

    def make():
        return lambda batch: np.asarray(batch, np.float32).mean(axis=(1, 2))
    one = {(r["image"], r["replica"]): r["logits"] for r in I.score_replicas(df, make, 3, "dermatologic", 6, 6, 3, batch_size=4).collect()}
    views = I.replicas(df, "dermatologic", 6, 6, 3)
    two = {(r["image"], r["replica"]): r["logits"] for r in I.score(views, make, 3, 4, (6, 6, 3)).collect()}
    assert one.keys() == two.keys() and len(one) == 15
    assert all(np.allclose(one[k], two[k], atol=1e-6) for k in one)


def test_components_share_one_reading_and_resume(spark, tmp_path):
    from stackpool.plans import stack as K
    pics = table(spark, {f"p{i}": mesh(6 + i % 2, 7) * (i + 1) % 256 for i in range(9)}).repartition(3)

    def head(scale, fails=False):
        def make():
            if fails:
                raise RuntimeError("must not run")
            return lambda batch: np.asarray(batch, np.float64).mean(axis=(1, 2)) * scale
        return make
    parts = [K.Component(f"c{i}", head(i + 1), "dermatologic", 4 + i // 3, 4, {"normalise": 0}) for i in range(5)]
    got = K.predict_components(pics, parts, str(tmp_path / "run"), 3, "avg")
    rows = {(r["component"], r["image"]): (r["p_m"], r["p_k"]) for r in got.collect()}
    assert len(rows) == 5 * 9
    for c in parts:
        one = K.component_projection(K.score_component(pics, c.model, c.treatment, c.height, c.width, 3, "avg", normalise=0))
        for r in one.collect():
            assert rows[c.name, r["image"]] == pytest.approx((r["p_m"], r["p_k"]), abs=1e-9)
    # a run that was cut off: one component is whole, one was left without its mark
    again = tmp_path / "again"
    got.filter("component = 'c1'").drop("component").write.parquet(str(again / "c1"))
    got.filter("component = 'c2'").drop("component").limit(2).write.parquet(str(again / "c2"))
    (again / "c2" / "_SUCCESS").unlink()
    parts[1] = K.Component("c1", head(2, True), "dermatologic", 4, 4, {"normalise": 0})
    resumed = K.predict_components(pics, parts, str(again), 3, "avg")
    assert {(r["component"], r["image"]): (r["p_m"], r["p_k"]) for r in resumed.collect()} == rows
    with pytest.raises(ValueError):
        K.predict_components(pics, [parts[0], parts[0]], str(again), 3, "avg")


def test_components_read_the_pictures_once(spark):
    pics = table(spark, {"p": mesh(6, 6)})
    models = {f"m{i}": (None, "dermatologic", 4, 4, {}) for i in range(21)}
    text = I.score_models(pics, models, 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInPandas") == 1


def test_crop_windows_as_columns_equal_the_kernel(spark):
    boxes = [None, [], [[0.0, 0.0, 0.2, 0.2]], [[0.4, 0.4, 0.4, 0.9], [0.7, 0.1, 1.0, 0.6]], [[0.0, 0.0, 0.0, 0.0]]]
    rows = [(f"p{k}", 3 + 11 * k % 90, 4 + 17 * k % 130, k % 3, boxes[k % 5]) for k in range(300)]
    df = spark.createDataFrame(rows, "image string, height int, width int, replica int, boxes array<array<double>>")
    out = I.crop_boxes(df, seed=5, boxes="boxes", area=(0.02, 0.6))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["image"]: tuple(r)[2:] for r in out.collect()}
    assert got == {i: X.sample_box(h, w, lambda a: uniforms(5, i, r, "box", a), b, area=(0.02, 0.6)) for i, h, w, r, b in rows}
    # one list for all pictures
    every = {r["image"]: tuple(r)[2:] for r in I.crop_boxes(df, boxes=[(0.0, 0.0, 0.5, 0.5)]).collect()}
    assert every == {i: X.sample_box(h, w, lambda a: uniforms(0, i, r, "box", a), [(0.0, 0.0, 0.5, 0.5)]) for i, h, w, r, _ in rows}


def test_random_crop_takes_boxes_of_each_picture(spark):
    pics = {f"p{k}": mesh(12 + k, 17) for k in range(6)}
    df = table(spark, pics).withColumn("boxes", F.when(F.col("image") != "p0", F.array(F.array(*[F.lit(x) for x in (0.5, 0.5, 1.0, 1.0)]))))
    windows = {r["image"]: tuple(r)[2:] for r in I.crop_boxes(df, boxes="boxes").collect()}
    cut = arrays(I.random_crop(df, boxes="boxes", scale=1.0, dtype="double"))
    for k, (top, left, h, w) in windows.items():
        assert np.array_equal(cut[k], pics[k][top:top + h, left:left + w])


def test_listing_goes_folder_by_folder(spark, tmp_path, monkeypatch):
    from stackpool.queries import files
    from stackpool.queries import tables as Q
    monkeypatch.setattr(files.files_in_folders, "__defaults__", (16,))
    given, whole = [], Q.list_pictures
    monkeypatch.setattr(Q, "list_pictures", lambda s, path, glob: given.append(path) or whole(s, path, glob))
    spark.range(100).selectExpr("id as doc_id", "'en' as lang").write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.list_files(spark, str(tmp_path))
    assert sorted(r["image"] for r in got.collect()) == sorted(f"D{i}.v1" for i in range(100))
    folders = given[0]
    assert len(folders) == 7 and not any(".jpg" in f for f in got.inputFiles())
    # as one read of all of them gives it, and with the glob
    root = folders[0].rpartition("/")[0]
    assert sorted(map(tuple, list_files(spark, folders, "*5.v1.jpg").collect())) == sorted(map(tuple, list_files(spark, root, "*5.v1.jpg").collect()))
