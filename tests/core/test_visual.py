import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brambling.functions import sift
from brambling.operators import visual_index as vi
from brambling.operators import visual_search as vs
from brambling.service import Engine
from brambling.sources.tables import IndexStore, extract_descriptors, read_metadata


@pytest.fixture
def parts(spark):
    # words 0, 1, 2 at the unit points; image 1 has words 0 0 1, image 2 has 1, image 3 has 1 2, image 4 has no descriptors
    book = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0])], "word int, center array<double>")
    at = {0: [0.9, 0.0, 0.0], 1: [0.0, 0.9, 0.1], 2: [0.0, 0.1, 0.9]}
    rows = [(i, at[w]) for i, ws in {1: [0, 0, 1], 2: [1], 3: [1, 2]}.items() for w in ws]
    own = spark.createDataFrame(rows, "image_id int, vec array<double>")
    images = spark.createDataFrame([(1,), (2,), (3,), (4,)], "image_id int")
    return own, book, vi.build_visual_index(own, book, images)


def test_index_by_hand(parts):
    _, _, index = parts
    assert {(r["image_id"], r["word"]): round(r["tf"], 6) for r in index.histograms.collect()} == {(1, 0): 0.666667, (1, 1): 0.333333, (2, 1): 1.0, (3, 1): 0.5, (3, 2): 0.5}
    idf = {r["word"]: (r["df"], r["idf"]) for r in index.idf.collect()}
    assert idf[1] == (3, 0.0) and idf[0][1] == pytest.approx(math.log(2))
    norms = {r["image_id"]: r["norm"] for r in index.norms.collect()}
    assert norms[4] == 0.0 and norms[2] == 0.0


def test_modes_and_empty_query(parts):
    own, _, index = parts
    asked = own.filter("image_id = 1")
    one = {r["image_id"]: r["score"] for r in vs.search(asked, index, 10, "sequential").collect()}
    two = {r["image_id"]: r["score"] for r in vs.search(asked, index, 10).collect()}
    assert one == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0} and two == {1: 1.0}
    none = own.filter("image_id = 99")
    assert vs.search(none, index, 10, "sequential").count() == vs.search(none, index, 10).count() == 0


def test_negative_idf_makes_modes_disagree(spark):
    book = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "word int, center array<double>")
    own = spark.createDataFrame([(1, [0.0]), (1, [1.0]), (2, [0.0])], "image_id int, vec array<double>")
    index = vi.build_visual_index(own, book)
    asked = own.filter("image_id = 2")  # only the word that every image has
    assert {r["image_id"] for r in vs.search(asked, index, 5, "sequential").collect()} == {1, 2}
    assert vs.search(asked, index, 5).count() == 0


def test_codebooks_of_many_stretches(spark):
    rows = [(i, [float(i % 7), float(i * i % 11)]) for i in range(60)]
    own = spark.createDataFrame(rows, "image_id int, vec array<double>")
    book = spark.createDataFrame([(w, [float(w % 7), float(w % 5)]) for w in range(35)] + [(40, [0.0, 0.0])], "word int, center array<double>")
    one, many = ({r["image_id"]: r["word"] for r in vi.assign_words(own, book, stretch).collect()} for stretch in (100, 5))
    assert one == many and one[0] == 0


def test_ties_are_ordered_by_id(spark, parts):
    hits = spark.createDataFrame([(i, 0.5) for i in (5, 3, 9, 1)], "image_id int, score double")
    assert [r["image_id"] for r in vs.top_k(hits, 3).collect()] == [1, 3, 5]
    with pytest.raises(ValueError):
        vs.top_k(hits, -1)


def test_stored_index_keeps_its_codebook(spark, tmp_path, parts):
    store = IndexStore(spark, str(tmp_path))
    own, book, index = parts
    images = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "image_id int")
    kept = store.save_visual("a", own, book, images)
    for name in ("histograms", "idf", "postings", "norms"):
        assert sorted(map(tuple, getattr(kept, name).collect())) == sorted(map(tuple, getattr(index, name).collect()))
    again = store.save_visual("a", own.filter("image_id < 3"))  # the codebook is there, so none is trained
    assert sorted(r["word"] for r in again.codebook.collect()) == [0, 1, 2] and again.norms.count() == 2
    plan = kept.postings.filter("word = 1")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan


def _jpeg(spark, grey, path):
    """Writes a grey or coloured array as a file, by the library that Java has."""
    jvm = spark._jvm
    h, w = grey.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 5)  # three bytes a sample, blue first
    full = np.repeat(grey[:, :, None], 3, axis=2) if grey.ndim == 2 else grey
    image.getRaster().getDataBuffer()
    colour = (full[:, :, 0].astype(int) << 16) | (full[:, :, 1].astype(int) << 8) | full[:, :, 2]
    array = spark.sparkContext._gateway.new_array(jvm.int, h * w)
    for i, c in enumerate(colour.ravel().tolist()):
        array[i] = c
    image.setRGB(0, 0, w, h, array, 0, w)
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))


def _scene(seed, size=64):
    """Blobs and bars on a plain ground."""
    rnd = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size]
    out = np.full((size, size), 90.0)
    for _ in range(24):
        cy, cx, s, a = rnd.uniform(8, size - 8), rnd.uniform(8, size - 8), rnd.uniform(1.5, 4), rnd.uniform(-80, 130)
        out += a * np.exp(-((y - cy) ** 2 + (x - cx) ** 2 * rnd.uniform(0.3, 1)) / (2 * s * s))
    return np.clip(out, 0, 255).astype(np.uint8)


def test_features_survive_a_turn_and_brightness():
    image = _scene(1)
    one, two = sift.keypoints(image), sift.keypoints(np.rot90(image).copy())
    bright = sift.keypoints(np.clip(image * 0.8 + 20, 0, 255).astype(np.uint8))
    assert len(one) >= 8 and one[0][-1].shape == (128,) and 0 <= min(k[-1].min() for k in one) and max(k[-1].max() for k in one) <= 255
    for other, place in ((two, lambda y, x: (63 - x, y)), (bright, lambda y, x: (y, x))):
        vectors = np.stack([k[-1] for k in other])
        good = 0
        for k in one:
            best = other[int(((vectors - k[-1]) ** 2).sum(axis=1).argmin())]
            y, x = place(k[1], k[2])
            good += abs(best[1] - y) < 1.5 and abs(best[2] - x) < 1.5
        assert good >= 0.8 * len(one)


def test_flat_and_tiny_images_have_no_features():
    assert sift.descriptors(np.full((40, 40), 7, np.uint8)) is None and sift.descriptors(np.zeros((1, 1), np.uint8)) is None
    assert len(sift.descriptors(_scene(2), 5)) == 5
    assert sift.to_grey(b"", -1, -1, -1) is None and sift.to_grey(bytes([10, 20, 30]), 1, 1, 3).tolist() == [[22]]


def test_image_search_from_files_and_uploads(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    for i in range(5):
        _jpeg(spark, _scene(10 + i), folder / f"{i}.jpg")
    _jpeg(spark, np.full((32, 32), 128, np.uint8), folder / "plain.jpg")
    (folder / "broken.jpg").write_bytes(b"no image")
    (folder / "note.txt").write_text("x")
    (tmp_path / "styles.csv").write_text("id,gender,year,productDisplayName\n3,Men,2011,Blue shirt\n3,Men,2011,Blue shirt\n4,Women,2012\n", encoding="utf-8")
    meta = read_metadata(spark, str(tmp_path / "styles.csv"))
    assert [(r["id"], r["title"]) for r in meta.collect()] == [("3", "Blue shirt")]
    engine = Engine(spark, str(tmp_path / "store"))
    engine.build_images("images", str(folder), k=12)
    index = engine.store.load_visual("images")
    assert {r["image_id"]: r["norm"] > 0 for r in index.norms.collect()} == {**{f"{i}.jpg": True for i in range(5)}, "plain.jpg": False, "broken.jpg": False}
    upload = (folder / "3.jpg").read_bytes()
    for method in ("inverted", "secuencial"):
        found = engine.search_image(upload, meta, k=3, method=method)["results"]
        assert found[0]["id"] == "3.jpg" and found[0]["score"] == pytest.approx(1) and (found[0]["title"], found[0]["year"]) == ("Blue shirt", "2011")
    assert len(engine.search_image(upload, meta, k=20, method="secuencial")["results"]) == 7
    for nothing in (b"no image", (folder / "plain.jpg").read_bytes()):
        assert engine.search_image(nothing, meta) == {"results": []}


def test_extractor_errors_and_none_are_no_features(spark, tmp_path):
    images = spark.createDataFrame([(str(n), 1, 2, 1, bytes([n, n])) for n in range(3)], "image_id string, height int, width int, channels int, data binary")

    def odd(grey):
        if grey[0, 0] == 1:
            raise RuntimeError("odd")
        return None if grey[0, 0] == 2 else np.array([[1.5, 2.0], [3.0, 4.0]])

    got = [(r["image_id"], r["ord"], r["vec"]) for r in extract_descriptors(images, odd).orderBy("ord").collect()]
    assert got == [("0", 0, [1.5, 2.0]), ("0", 1, [3.0, 4.0])]


def test_metadata_defaults(spark, parts):
    hits = spark.createDataFrame([("7.jpg", 0.5), ("8.jpg", 0.4)], "image_id string, score double")
    meta = spark.createDataFrame([("7", "Shirt", None, 2011), ("7", "Shirt", None, 2011)], "id string, title string, gender string, year int")
    got = {r["id"]: (r["title"], r["gender"], r["year"]) for r in vs.format_hits(hits, meta).collect()}
    assert got == {"7.jpg": ("Shirt", "", "2011"), "8.jpg": ("Sin título", "", "")}


def test_trained_codebook_is_repeatable(spark):
    rows = [(i % 20, [float(i % 3), float(i % 5)]) for i in range(200)]
    own = spark.createDataFrame(rows, "image_id int, vec array<double>")
    a, b = (sorted(map(tuple, (r["center"] for r in vi.train_codebook(own, k=3).collect()))) for _ in range(2))
    assert a == b
    again = sorted(map(tuple, (r["center"] for r in vi.train_codebook(own.repartition(5), k=3).collect())))
    assert a == again and len(vi.train_codebook(own, k=40, batch=8).collect()) == 40
    stats = vi.cluster_stats(vi.assign_words(own, vi.train_codebook(own, k=3)), vi.train_codebook(own, k=3)).collect()[0]
    assert stats["k"] == 3 and stats["mean_size"] == pytest.approx(200 / 3, abs=1e-5)
    assert vi.assign_words(own, vi.train_codebook(own, k=3)).filter(F.col("word").isNull()).count() == 0
