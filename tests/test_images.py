"""Image files: written from a table, read back by batch and stream."""

import struct
import zlib

from quire import fixtures as fx
from quire.functions import images as measures
from quire.sources import images


def png(width, height, data, kind=0):
    """A PNG of 8-bit samples: grey (0) or RGB (2)."""
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    row = width * (3 if kind == 2 else 1)
    lines = b"".join(b"\0" + data[k * row : (k + 1) * row] for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def _boxes(df):
    return {r.name: (r.pixels and tuple(r.pixels), r.page and tuple(r.page)) for r in df.collect()}


def test_images_from_a_table(spark, tmp_path):
    rows = fx.grey_images(spark, "/root/testdata/sf0.001").limit(40).collect()
    folder = tmp_path / "in"
    folder.mkdir()
    for r in rows:
        (folder / f"{r.vec_id}.png").write_bytes(png(8, 8, bytes(r.image.data)))
    (folder / "blank.png").write_bytes(png(3, 2, bytes([255] * 6)))
    (folder / "colour.png").write_bytes(png(2, 2, bytes([255, 255, 255] * 3 + [10, 20, 30]), 2))
    (folder / "cut.png").write_bytes(png(8, 8, bytes(64))[:20])
    (folder / "empty.png").write_bytes(b"")
    (folder / "text.png").write_bytes(b"no image at all")
    found = _boxes(images.foreground(images.image_files(spark, str(folder))))
    of = lambda r, pad: measures.foreground_box(*(r[f"image.{c}"] for c in ("height", "width", "nChannels", "data")), pad)
    table = spark.createDataFrame([(r.vec_id, r.image) for r in rows], fx.grey_images(spark, "/root/testdata/sf0.001").select("vec_id", "image").schema)
    want = table.select("vec_id", of(table, False).alias("pixels"), of(table, True).alias("page")).collect()
    assert {k: v for k, v in found.items() if k[0].isdigit()} == {f"{r.vec_id}.png": (r.pixels and tuple(r.pixels), r.page and tuple(r.page)) for r in want}
    assert found["colour.png"][0] == (1.0, 1.0, 1.0, 1.0)
    assert all(v is None for v in (found["blank.png"][0] or (None,)))
    dead = {r.name for r in images.sorted_out(images.image_files(spark, str(folder)))[1].collect()}
    assert dead == {"cut.png", "text.png"}  # a file of no bytes is no row

    stream = images.foreground(images.image_stream(spark, str(folder), 7))
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    assert _boxes(spark.read.parquet(f"{tmp_path}/out")) == found
