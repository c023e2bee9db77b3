"""Raster kernels of box sets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Images rasterized at once; boxes of an image up to which its parts come from pairs of boxes, not from its cells.
IMAGES, PAIRS = 512, 64


def _flood(left) -> int:
    """4-connected parts of a mask."""
    import numpy as np

    parts = 0
    while left.any():
        parts += 1
        part = np.zeros_like(left)
        part[tuple(np.argwhere(left)[0])] = True
        while True:
            grown = part.copy()
            grown[1:] |= part[:-1]
            grown[:-1] |= part[1:]
            grown[:, 1:] |= part[:, :-1]
            grown[:, :-1] |= part[:, 1:]
            grown &= left
            if (grown == part).all():
                break
            part = grown
        left = left & ~part
    return parts


def _parts(box, image, n: int):
    """Parts of each image 0 .. n - 1 from its boxes (x0, y0, x1, y1) in cells, none empty, in order of image: boxes
    that overlap or share an edge are one part, corners alone don't link."""
    import numpy as np

    size = np.bincount(image, minlength=n)
    first = np.concatenate([[0], np.cumsum(size)])[image]  # of the box's image
    a = np.repeat(np.arange(len(box)), np.arange(len(box)) - first)
    b = np.arange(len(a)) - np.repeat(np.cumsum(np.arange(len(box)) - first) - (np.arange(len(box)) - first), np.arange(len(box)) - first) + first[a]
    w = np.minimum(box[a, 2], box[b, 2]) - np.maximum(box[a, 0], box[b, 0])
    h = np.minimum(box[a, 3], box[b, 3]) - np.maximum(box[a, 1], box[b, 1])
    ok = (w >= 0) & (h >= 0) & (w + h > 0)
    a, b, label = a[ok], b[ok], np.arange(len(box))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return np.bincount(image[label == np.arange(len(box))], minlength=n)
        label = new


def _fractions(sizes, sides, width: int, height: int):
    """(fraction, parts) of images that hold so many of the boxes (x0, y0, x1, y1), NaN for unknown sides."""
    import numpy as np

    image = np.repeat(np.arange(len(sizes)), sizes)
    known = ~np.isnan(sides).any(axis=1)
    cells = np.clip(np.rint(sides[known]), 0, [width, height, width, height]).astype(np.int64)
    image = image[known]
    full = (cells[:, 0] < cells[:, 2]) & (cells[:, 1] < cells[:, 3])
    cells, image = cells[full], image[full]
    mask = np.zeros((len(sizes), height, width), dtype=bool)
    for i, (x0, y0, x1, y1) in zip(image.tolist(), cells.tolist(), strict=True):
        mask[i, y0:y1, x0:x1] = True
    many = np.bincount(image, minlength=len(sizes)) > PAIRS
    few = ~many[image]
    parts = _parts(cells[few], image[few], len(sizes))
    for i in np.flatnonzero(many).tolist():
        parts[i] = _flood(mask[i])
    return np.count_nonzero(mask.reshape(len(sizes), -1), axis=1) / (width * height), parts


def area_fractions(boxes: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """(key, fraction, parts): share of a width x height region under the union of boxes, and its connected parts.

    An image is one row with the array of its boxes, and many images are rasterized in one call; the mask is width x
    height cells whatever the number of boxes. A box with an unknown side covers nothing.
    """
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for all_ in batches:
            for at in range(0, all_.num_rows, IMAGES):
                batch = all_.slice(at, IMAGES)
                lists = batch.column("boxes")
                flat = lists.flatten()
                sides = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "y0", "x1", "y1")], axis=1)
                fraction, parts = _fractions(np.diff(lists.offsets.to_numpy()), sides, width, height)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(fraction), pa.array(parts.astype(np.int64))], names=[key, "fraction", "parts"])

    kind = boxes.schema[key].dataType.simpleString()
    sides = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    images = boxes.groupBy(key).agg(F.collect_list(sides).alias("boxes"))
    return images.mapInArrow(run, f"{key} {kind}, fraction double, parts long")
