"""Images from files to working size, thumbnail and rasters."""

import numpy as np
import pytest

from pigmentum.operators import kernels, raster
from pigmentum.sources import uploads


@pytest.mark.parametrize(("size", "longest", "want"), [((4800, 2400), 2400, (2.0, 2400, 1200)), ((10, 3), 20, (1.0, 10, 3)), ((5000, 1), 360, (5000 / 360, 360, 1)), ((333, 250), 100, (3.33, 100, 75))])
def test_fitted(size, longest, want):
    assert raster.fitted(*size, longest) == want


def test_files_to_rasters(spark, tmp_path):
    rng = np.random.default_rng(1)
    sizes = {"wide": (30, 2500), "small": (3, 5), "tall": (900, 40)}
    shown = {n: np.broadcast_to(rng.integers(0, 256, (h, w, 3)), (h, w, 3)) for n, (h, w) in sizes.items()}
    for n, rgb in shown.items():
        (tmp_path / f"{n}.png").write_bytes(kernels.png(rgb.astype(np.uint8)))
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {r.origin.rsplit("/", 1)[1][:-4]: r for r in raster.normalise(uploads.images(spark, str(tmp_path))).collect()}
    assert set(got) == set(sizes)
    assert {n: (r.orig_w, r.orig_h, r.w, r.h, r.thumb_w, r.thumb_h) for n, r in got.items()} == {"wide": (2500, 30, 2400, 29, 480, 6), "small": (5, 3, 5, 3, 5, 3), "tall": (40, 900, 40, 900, 40, 900)}
    assert [(x.longest, x.w, x.h) for x in got["tall"].rasters] == [(360, 16, 360), (1800, 40, 900)]
    assert got["tall"].rasters[1].data == shown["tall"].astype(np.uint8).tobytes() and got["small"].rasters[0].data == shown["small"].astype(np.uint8).tobytes()
    assert abs(int(got["tall"].rasters[0].data[0]) - shown["tall"][:2, :2, 0].mean()) <= 1
    (tmp_path / "out").mkdir()
    for n, r in got.items():
        (tmp_path / "out" / f"{n}.png").write_bytes(r.thumbnail)
    back = {r.origin.rsplit("/", 1)[1][:-4]: (r.width, r.height) for r in uploads.images(spark, str(tmp_path / "out")).collect()}
    assert back == {"wide": (480, 6), "small": (5, 3), "tall": (40, 900)}


def test_rows_without_an_image(spark):
    rows = [(1, 2, 2, 3, bytearray(11)), (2, 2, 2, 3, None), (3, 0, 2, 3, bytearray()), (4, 1, 1, 4, bytearray([1, 2, 3, 9])), (4, 1, 1, 4, bytearray([1, 2, 3, 9]))]
    df = spark.createDataFrame(rows, "id int, width int, height int, nChannels int, data binary")
    got = raster.normalise(df, "id").collect()
    assert [r.id for r in got] == [4, 4] and got[0].rasters[0].data == bytes([3, 2, 1])
    assert raster.normalise(df.limit(0), "id").count() == 0
