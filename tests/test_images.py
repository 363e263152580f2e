import numpy as np
import pytest

from paperloom.operators import images as im


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 8, 8, rng.integers(0, 256, 64).tolist()) for i in range(20)] + [(20, 4, 6, list(range(24)))]
    return spark.createDataFrame(rows, "doc_id int, width int, height int, px array<int>")


@pytest.mark.parametrize("method", ["bilinear", "bicubic", "lanczos"])
def test_resize_keeps_flat_images_and_sizes(method):
    flat = np.full((2, 9, 7), 131, dtype=np.uint8)
    assert (im.resize_stack(flat, 5, method) == 131).all()
    same = np.arange(64, dtype=np.uint8).reshape(1, 8, 8)
    assert (im.resize_stack(same, 8, method) == same).all()


def test_bilinear_by_hand():
    got = im.resize_stack(np.array([[[0, 100]], [[50, 250]]], dtype=np.uint8), 4, "bilinear")
    assert got[0, 0].tolist() == [0, 25, 75, 100] and got[1, 3].tolist() == [50, 100, 200, 250]


def test_mixed_sizes_stay_in_order(images):
    rows = {r.doc_id: r for r in im.resize(images, 4, "bicubic").collect()}
    assert len(rows) == 21 and all(len(r.px) == 16 and r.width == 4 for r in rows.values())
    src = {r.doc_id: r for r in images.collect()}
    for i in (0, 20):
        one = np.array(src[i].px, dtype=np.uint8).reshape(1, src[i].height, src[i].width)
        assert list(rows[i].px) == im.resize_stack(one, 4, "bicubic").ravel().tolist()


def test_hog_width_and_range(images):
    row = im.hog_features(images).first()
    assert len(row.features) == 8100 and 0 <= min(row.features) and max(row.features) <= 1
    edge = np.zeros((1, 16, 16))
    edge[:, :, 8:] = 1.0
    cells = im.hog_stack(edge, 8).reshape(2, 2, 9)
    assert (cells[..., 1:] == 0).all() and (cells[..., 0] > 0).all()


def test_otsu_by_hand():
    def slow(px):
        best, at = -1.0, 0
        for t in range(256):
            low, high = px[px <= t], px[px > t]
            if len(low) and len(high):
                v = len(low) * len(high) * (low.mean() - high.mean()) ** 2
                if v > best * (1 + 1e-12):
                    best, at = v, t
        return at

    rng = np.random.default_rng(2)
    for _ in range(30):
        px = rng.integers(0, 256, 50)
        assert im.otsu_level(px) == slow(px)
    assert im.otsu_level(np.full(9, 7)) == 0


def test_augment_repeats_whatever_the_partitions(images):
    square = images.where("doc_id < 20")
    once = {r.doc_id: bytes(r.px) for r in im.augment(square.repartition(1)).collect()}
    again = {r.doc_id: bytes(r.px) for r in im.augment(square.repartition(7)).collect()}
    other = {r.doc_id: bytes(r.px) for r in im.augment(square, epoch=1).collect()}
    assert once == again and once != other
