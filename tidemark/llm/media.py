"""Media columns: payloads stored as progressive JPEG, read back to coefficients and RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import jpeg
from tidemark.llm.chunks import slices

BATCH_BYTES = 1 << 20  # payload encoded or decoded at once
START, END = b"\xff\xd8", b"\xff\xd9"


def payload(text: str | None) -> bytes:
    """A text as UTF-8, with spaces up to a positive multiple of an image unit."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % jpeg.MCU_BYTES if raw else jpeg.MCU_BYTES)


def _batches(rows: Iterator, size) -> Iterator[list]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


def images_of(form: bytes) -> list[bytes]:
    """The images of a stored form; an end-of-image marker before a start-of-image marker stands only between them."""
    parts = form.split(END + START)
    return [(START if i else b"") + p + (END if i < len(parts) - 1 else b"") for i, p in enumerate(parts)]


class Reading:
    """What is read back of one stored form, image by image: digests of the payload and exact sums of the RGB tensors."""

    def __init__(self):
        self.size, self.tail, self.digest = 0, b"", hashlib.sha256()
        self.pixels, self.sums, self.squares, self.shapes = 0, [0] * 3, [0] * 3, []

    def add(self, part: bytes | None, image: np.ndarray) -> None:
        part = part or b""
        self.size += len(part)
        self.digest.update(part)
        self.tail = (self.tail + part[-16:])[-16:]
        flat = image.reshape(-1, 3).astype(np.int64)
        self.pixels += len(flat)
        self.sums = [a + int(b) for a, b in zip(self.sums, flat.sum(0))]
        self.squares = [a + int(b) for a, b in zip(self.squares, (flat * flat).sum(0))]
        self.shapes.append(f"{image.shape[1]}x{image.shape[0]}")

    def feature(self) -> str:
        """Number and size of the images, then mean and standard deviation of each channel."""
        means = [s / self.pixels for s in self.sums]
        spread = [max(0, q * self.pixels - s**2) ** 0.5 / self.pixels for s, q in zip(self.sums, self.squares)]
        return f"{'+'.join(self.shapes)}:" + ",".join(f"{v:.3f}" for v in [*means, *spread])


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (progressive JPEG holding the text's bytes losslessly) of every row; encoded image by image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = jpeg.IMAGE_MCUS * jpeg.MCU_BYTES
        for batch in slices(batches, 500):
            sizes: list[int] = []
            media: list[list[bytes]] = [[] for _ in range(batch.num_rows)]

            def parts() -> Iterator[tuple[int, bytes]]:
                for row, text in enumerate(batch.column(1)):
                    raw = text.as_py()
                    sizes.append(len((raw or "").encode()))
                    raw = payload(raw)
                    for at in range(0, len(raw), step):
                        yield row, raw[at : at + step]

            for part in _batches(parts(), lambda r: len(r[1])):
                for (row, _), image in zip(part, jpeg.encode([p for _, p in part])):
                    media[row].append(image)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([b"".join(m) for m in media], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _decoded(forms: Iterator[tuple[object, bytes | None]]) -> Iterator[tuple[object, bytes | None, np.ndarray]]:
    """(key, payload, RGB tensor) of every image of the forms, in order."""
    images = ((key, image) for key, form in forms if form for image in images_of(form))
    for part in _batches(images, lambda r: len(r[1])):
        read, tensors = jpeg.decode([m for _, m in part])
        for (key, _), payload_, own in zip(part, read, tensors):
            for image in own:
                yield key, payload_, image


def decode_media(stored: DataFrame, media: str = "media") -> DataFrame:
    """doc_id and, for each image of each stored form, its number, height, width and full-resolution RGB tensor (row by row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers = batch.column(0).to_pylist(), [0] * batch.num_rows
            for part in _batches(_decoded(enumerate(x.as_py() for x in batch.column(1))), lambda r: r[2].size):
                rows = []
                for row, _, image in part:
                    rows.append((ids[row], numbers[row], *image.shape[:2], image.tobytes()))
                    numbers[row] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["doc_id", "image", "height", "width", "rgb"])

    return stored.select("doc_id", media).mapInArrow(run, "doc_id long, image int, height int, width int, rgb binary")


def media_digest(stored: DataFrame) -> DataFrame:
    """Read stored forms back: digests of the payload and of the form, and the tensors' feature, per row.

    The payload comes from the coefficients of the decoded images; the feature from
    their RGB tensors. Equal stored forms give equal values. Images are decoded one after
    the other, so that a form's length costs no memory beyond its own bytes.
    """
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            readings = [Reading() for _ in range(batch.num_rows)]
            for row, part, image in _decoded(enumerate(x.as_py() for x in batch.column(2))):
                readings[row].add(part, image)
            forms = [(len(m), hashlib.sha256(m).hexdigest()) for m in (x.as_py() for x in batch.column(2))]
            columns = [[r.size for r in readings], [r.digest.hexdigest() for r in readings], [zlib.crc32(r.tail) for r in readings], [n for n, _ in forms], [h for _, h in forms], [r.feature() for r in readings]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.string() if name.endswith(("sha256", "feature")) else pa.int64()) for name, c in zip(names[2:], columns)]], names)

    return stored.mapInArrow(run, kinds)


def documents_as_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text (null: empty) as progressive JPEG and read it back.

    One row per document, repeated rows included; other columns are ignored. Nothing
    is shuffled and a task holds one batch of images: a very long text becomes several
    images of bounded size.
    """
    return media_digest(store_media(docs, doc_id, text))
