import struct

import numpy as np

from shelfkin.operators import embedding, pictures
from shelfkin.plans.build_vectors import build_vectors, store_vectors
from shelfkin.schema import PRODUCT_SCHEMA
from shelfkin.sources import image_files


def bitmap(pixels):
    """BMP bytes of (height, width, 3) RGB pixels."""
    height, width = pixels.shape[:2]
    pad = b"\0" * (-width * 3 % 4)
    rows = b"".join(pixels[y, :, ::-1].tobytes() + pad for y in range(height - 1, -1, -1))
    head = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def plain(colour, height=6, width=10):
    return np.full((height, width, 3), colour, dtype=np.uint8)


def write(folder, name, data):
    (folder / name).write_bytes(data)


def test_reading_skips_broken_files_and_keeps_products(spark, tmp_path):
    write(tmp_path, "red.bmp", bitmap(plain((255, 0, 0))))
    write(tmp_path, "broken.bmp", b"not a picture")
    images = image_files.read_images(spark, str(tmp_path))
    rows = [(1, "x/red.bmp"), (2, "x/broken.bmp"), (3, "x/none.bmp"), (4, None)]
    products = spark.createDataFrame(rows, "id long, image_path string")
    joined = image_files.with_images(products, images, "x")
    assert {r["id"]: r["image"] is not None for r in joined.collect()} == {1: True, 2: False, 3: False, 4: False}
    image = joined.filter("id = 1").first()["image"]
    assert (image["height"], image["width"]) == (6, 10)
    assert (pictures.rgb(image.asDict())[0, 0] == [255, 0, 0]).all()


def test_equal_names_in_two_folders_stay_apart(spark, tmp_path):
    for name, colour in (("x", (255, 0, 0)), ("y", (0, 0, 255))):
        (tmp_path / name).mkdir()
        write(tmp_path / name, "1.bmp", bitmap(plain(colour)))
    products = spark.createDataFrame([(1, "x/1.bmp"), (2, "y/1.bmp"), (3, "1.bmp")], "id long, image_path string")
    joined = image_files.with_images(products, image_files.read_images(spark, str(tmp_path)))
    got = {r["id"]: r["image"] and pictures.rgb(r["image"].asDict())[0, 0].tolist() for r in joined.collect()}
    assert got == {1: [255, 0, 0], 2: [0, 0, 255], 3: None}


def test_shared_pictures_are_encoded_once(spark, tmp_path):
    write(tmp_path, "a.bmp", bitmap(plain((10, 20, 30))))
    products = spark.createDataFrame([(k, "c", "n", "d", "a.bmp") for k in range(6)], PRODUCT_SCHEMA)
    built = build_vectors(products, image_files.read_images(spark, str(tmp_path)), 16)
    assert len({tuple(r["image"]) for r in built.collect()}) == 1 and built.count() == 6


def test_plain_picture_becomes_the_scaled_colour():
    picture = {"height": 6, "width": 10, "nChannels": 3, "data": plain((51, 102, 204))[:, :, ::-1].tobytes()}
    tensor = pictures.standard_tensor(picture)
    assert tensor.shape == (3, 224, 224)
    expected = (np.array([51, 102, 204]) / 255 - pictures.CHANNEL_MEAN) / pictures.CHANNEL_STD
    assert np.allclose(tensor.mean(axis=(1, 2)), expected, atol=1e-5)
    vector = pictures.colour_grid(tensor)
    assert vector.shape == (96,) and np.allclose(vector[48:], 0, atol=1e-5)


def test_crop_is_centred_on_tall_and_grey_pictures():
    rows = np.repeat(np.linspace(0, 255, 600).astype(np.uint8)[:, None], 300, axis=1)
    tensor = pictures.standard_tensor({"height": 600, "width": 300, "nChannels": 1, "data": rows.tobytes()})
    middle = tensor[0, 111:113].mean() * pictures.CHANNEL_STD[0] + pictures.CHANNEL_MEAN[0]
    assert abs(middle - 0.5) < 0.01
    assert tensor[0, 0, 0] < tensor[0, -1, 0]


def test_weights_sum_to_one_up_and_down():
    for old, new in [(8, 256), (1000, 256), (256, 256)]:
        weights = pictures.resize_weights(old, new)
        assert np.allclose(weights.sum(axis=1), 1)
    assert np.allclose(pictures.resize_weights(5, 5), np.eye(5))


def test_vectors_of_both_kinds_are_stored(spark, tmp_path):
    folder = tmp_path / "pics"
    folder.mkdir()
    write(folder, "a.bmp", bitmap(plain((10, 20, 30))))
    rows = [(1, "c", "n", "small red", "p/a.bmp"), (2, "c", "n", "large blue", "p/missing.bmp")]
    products = spark.createDataFrame(rows, PRODUCT_SCHEMA)
    stored = store_vectors(spark, products, image_files.read_images(spark, str(folder)), str(tmp_path / "store"), 32, "p")
    got = {r["id"]: (len(r["text"]), r["image"] and len(r["image"])) for r in stored.collect()}
    assert got == {1: (32, 96), 2: (32, None)}


def test_own_image_encoder(spark):
    data = bytearray(plain((0, 0, 0)).tobytes())
    images = spark.createDataFrame(
        [(1, ("o", 6, 10, 3, 16, data)), (2, None)],
        "id long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>",
    )
    vectors = embedding.embed_images(images, "id", lambda: lambda tensor: tensor.mean(axis=(1, 2)))
    got = {r["id"]: r["vector"] for r in vectors.collect()}
    assert len(got[1]) == 3 and got[2] is None
    assert embedding.image_tensors(images, "id").count() == 1


def test_files_are_written_by_tasks(spark, tmp_path):
    contents = spark.createDataFrame([(f"{i}.bin", bytearray([i])) for i in range(20)], "file_name string, content binary")
    done = image_files.write_files(contents.repartition(4), str(tmp_path / "out")).collect()
    assert len(done) == 20
    assert (tmp_path / "out" / "7.bin").read_bytes() == b"\x07"
