"""Operator 8, media columns: local image descriptors that find cropped or edited copies.

Corners are local maxima of the Harris response at several scales, placed between pixels. Around each the intensity
centroid gives the orientation, and 128 seeded comparisons of smoothed grey levels, turned to it and interpolated, give
the descriptor, which hardly depends on the pixel grid: copies turned by any angle are found like straight ones. Six
Hamming tables, each of two of the descriptor's four words, are joined on equality, so descriptors that differ in up to
two bits (or in one or two words) meet: each bucket's descriptors meet its first image's; then, where a bucket still
holds several classes, those of one image of each larger class, and at last those of all images of a larger class that enough
of the image's places meet at all; a bucket's images are dealt to tasks in parts of MEMBERS. Any two matches of two images fix a turn, a resizing and a shift; a
pair with CONSENSUS keypoints that agree on one is a link, and links make classes by union-find, the same as if all
pairs of images were compared. n_links follows from the class, so every copy of a picture has it. Keypoints are in
proportion to the area. An image is described by one task, in 130 bytes a pixel (measured at 4 million); stacks of small ones hold two million pixels.

Images are grey, row by row, in a binary column with width. A null, empty or misshapen image has no keypoints and is a
class of its own; so is a null media_id, which is never linked. Rows that repeat a media_id count once. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import combinations
from math import log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlume.llm.common import small_batches, stage
from gridlume.operators.graph import components
from gridlume.operators.lineage import release

#: Half-width of a patch, its border with turned tests, bits, angle steps, keypoints at each scale on AREA pixels.
HALF, BORDER, BITS, STEPS = 7, 8, 128, 32
SCALES = ((1.0, 24), (1.25, 16), (1.5, 12), (2.0, 8))
AREA = 2304
#: Keypoints that agree on one change; pixels at scale 1 and angle steps within which they do; part of a patch's contrast below which grey levels count as equal.
CONSENSUS, NEAR, TURN, EQUAL = 4, 2.0, 2, 0.25
#: Words of 32 bits, of BITS // 32, in which two descriptors that match are equal.
EQUAL_WORDS = 2
#: Keypoints that are described at once: they bound a worker's memory.
PLACES = 2048
#: Rows of one bucket that are dealt to one task.
MEMBERS = 1000
#: A keypoint's image and place.
COLUMNS = ["media_id", "y", "x", "scale", "angle"]


def tests() -> np.ndarray:
    """Test places before their turn: (BITS, 2, 2) of y, x within HALF of the corner."""
    p = np.random.default_rng(8).uniform(-HALF / 1.1, HALF / 1.1, (BITS, 2, 2))
    return p / np.maximum(1, np.linalg.norm(p, axis=2, keepdims=True) / HALF)


_tests = tests()
_y, _x = (v[np.hypot(*np.mgrid[-HALF : HALF + 1, -HALF : HALF + 1]) <= HALF] for v in np.mgrid[-HALF : HALF + 1, -HALF : HALF + 1])
#: The orientation's weights, which fall off towards the rim, so that pixels entering the disc as it turns count little.
_weight = np.exp(-(_y**2 + _x**2) / (2 * (HALF / 1.75) ** 2))


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2 r + 1) squares of a stack of images."""
    p = np.pad(a, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(1).cumsum(2)
    n = 2 * r + 1
    return p[:, n:, n:] - p[:, :-n, n:] - p[:, n:, :-n] + p[:, :-n, :-n]


def reduced(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return a
    at = [(np.arange(int(n / scale)) + 0.5) * scale - 0.5 for n in a.shape[1:]]
    lo = [np.clip(np.floor(p).astype(int), 0, n - 2) for p, n in zip(at, a.shape[1:], strict=True)]
    f = [(p - q).astype(np.float32) for p, q in zip(at, lo, strict=True)]
    rows = a[:, lo[0]] * (1 - f[0])[None, :, None] + a[:, lo[0] + 1] * f[0][None, :, None]
    return rows[:, :, lo[1]] * (1 - f[1]) + rows[:, :, lo[1] + 1] * f[1]


def between(a: np.ndarray, image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Grey levels at places between pixels, bilinear; places are inside by a pixel or more."""
    w = a.shape[2]
    i, j = y.astype(np.int64), x.astype(np.int64)
    at, flat = (image * a.shape[1] + i) * w + j, a.ravel()
    y, x = y - i, x - j
    top = flat.take(at) * (1 - x) + flat.take(at + 1) * x
    return top * (1 - y) + (flat.take(at + w) * (1 - x) + flat.take(at + w + 1) * x) * y


def summit(before: np.ndarray, here: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where the parabola through three neighbouring responses is highest, from the middle one, at most half a pixel."""
    bend = np.minimum(before - 2 * here + after, -1e-12)
    return ((before - after) / (2 * bend)).clip(-0.5, 0.5)


def described_places(a: np.ndarray, soft: np.ndarray, image: np.ndarray, y: np.ndarray, x: np.ndarray, scale: float) -> tuple[np.ndarray, ...]:
    patch = between(a, image[:, None], y[:, None] + _y, x[:, None] + _x)
    angle = np.arctan2((patch * _weight * _y).sum(1), (patch * _weight * _x).sum(1))
    cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    level = between(soft, image[:, None, None], y[:, None, None] + _tests[..., 0] * cos + _tests[..., 1] * sin, x[:, None, None] - _tests[..., 0] * sin + _tests[..., 1] * cos)
    # Levels that noise could reorder count as equal, in proportion to the contrast, which brightness and gain keep.
    equal = EQUAL * patch.std(1)[:, None] + 1e-6
    words = np.packbits(level[..., 0] < level[..., 1] - equal, axis=1).view(">i4").astype(np.int32)
    step = np.rint(angle / (2 * pi) * STEPS).astype(int) % STEPS
    # The first pixel of a reduced image lies (scale - 1) / 2 inside the image.
    return image, y * scale + (scale - 1) / 2, x * scale + (scale - 1) / 2, np.full(len(y), log(scale)), step, words


def keypoints(stack: np.ndarray) -> tuple[np.ndarray, ...]:
    """Image number, y, x (in the image's pixels), log scale, angle step and four 32-bit words of all keypoints of a stack."""
    found = []
    for scale, most in SCALES:
        a = reduced(stack.astype(np.float64), scale)
        n, h, w = a.shape
        if min(h, w) <= 2 * BORDER:
            continue
        # Three small boxes one after another are nearly round, so the response hardly changes as the image turns.
        gy, gx = np.gradient(box(a, 1) / 9, axis=(1, 2))
        xx, yy, xy = (box(box(box(g, 1), 1), 1) for g in (gx * gx, gy * gy, gx * gy))
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = np.full_like(r, -np.inf)
        inner[:, BORDER:-BORDER, BORDER:-BORDER] = r[:, BORDER:-BORDER, BORDER:-BORDER]
        top = inner.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                top = np.maximum(top, np.roll(inner, (dy, dx), (1, 2)))
        flat = np.where((inner == top) & (inner > 1), inner, -np.inf).reshape(n, -1)
        best = np.argsort(-flat, axis=1, kind="stable")[:, : most * max(AREA, stack[0].size) // AREA]
        image, place = np.nonzero(np.isfinite(np.take_along_axis(flat, best, 1)))
        place = best[image, place]
        y, x = place // w, place % w
        down, right = (summit(r[image, y - j, x - k], r[image, y, x], r[image, y + j, x + k]) for j, k in ((1, 0), (0, 1)))
        soft = box(box(a, 1), 1) / 81
        for i in range(0, len(y), PLACES):
            some = slice(i, i + PLACES)
            found.append(described_places(a, soft, image[some], (y + down)[some], (x + right)[some], scale))
    if not found:
        return (*[np.zeros(0)] * 5, np.zeros((0, 4), np.int32))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def described(media: DataFrame) -> DataFrame:
    """media_id, picture (a digest of shape and pixels), y, x, scale (log), angle (step) and words of each keypoint."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes: dict[tuple[int, int], list] = {}
            for key, width, image in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if image and width and len(image) % width == 0 and len(image) // width > 1 and width > 1:
                    shapes.setdefault((len(image) // width, width), []).append((key, image))
            for shape, same in shapes.items():
                stack = np.frombuffer(b"".join(i for _, i in same), np.uint8).reshape(-1, *shape)
                n = max(1, (1 << 21) // stack[0].size)
                parts = [keypoints(stack[i : i + n]) for i in range(0, len(stack), n)]
                image, y, x, scale, angle, words = (np.concatenate(c) for c in zip(*[(p[0] + i * n, *p[1:]) for i, p in enumerate(parts)], strict=True))
                ids = np.array([k for k, _ in same], np.int64)[image.astype(int)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * 4, pa.int32()), pa.array(words.ravel()))
                seen = [sha256(b"%d:%b" % (shape[1], i)).digest() for _, i in same]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([seen[i] for i in image.astype(int)], pa.binary()), *(pa.array(np.asarray(c, np.float32)) for c in (y, x, scale)), pa.array(np.asarray(angle, np.int32)), lists], ["media_id", "picture", "y", "x", "scale", "angle", "words"])

    small_batches(media.sparkSession)
    known = media.where("media_id IS NOT NULL").select(F.col("media_id").cast("long").alias("media_id"), F.col("width").cast("int").alias("width"), "image")
    return known.mapInArrow(rows, "media_id long, picture binary, y float, x float, scale float, angle int, words array<int>")


def agree(y_a: np.ndarray, x_a: np.ndarray, y_b: np.ndarray, x_b: np.ndarray, ratio: np.ndarray, turn: np.ndarray) -> bool:
    """Whether matches of enough places of image a agree on one turn, resizing and shift to image b.

    Any two matches fix a change, for which the others are counted; enough are CONSENSUS, and one more for each doubling
    of the matches beyond four, as among many more agree by chance. ratio and turn (in steps) are each match's own by its keypoints.
    """
    za, zb = x_a + 1j * y_a, x_b + 1j * y_b
    _, place = np.unique(za, return_inverse=True)
    enough = CONSENSUS + int(np.log2(max(1, len(za) / 4)))
    for i in range(len(za) - enough + 1):
        j = i + 1 + np.flatnonzero(np.abs(za[i + 1 :] - za[i]) >= 2 * HALF)
        if not len(j):
            continue
        change = (zb[j] - zb[i]) / (za[j] - za[i])
        off = np.angle(np.exp(2j * pi / STEPS * turn)[None] * np.exp(-1j * np.angle(change))[:, None]) * STEPS / (2 * pi)
        size = np.abs(change)[:, None]
        fits = (np.abs(off) <= TURN) & (np.abs(np.log(np.maximum(size, 1e-9)) - np.log(ratio)) <= 0.25)
        fits &= np.abs(zb[None] - zb[i] - change[:, None] * (za[None] - za[i])) <= NEAR * np.maximum(1, size)
        fits &= (fits[:, i] & fits[np.arange(len(j)), j])[:, None]
        for f in fits[fits.sum(1) >= enough]:
            if len(np.unique(place[f])) >= enough and len(np.unique(zb[f])) >= enough:
                return True
    return False


def agreed(match: DataFrame) -> DataFrame:
    """Pairs (a, b) of images with enough keypoints that agree on one change. match: a, b and the places of a keypoint of each that share words."""
    turn = F.pmod(F.col("angle_b") - F.col("angle_a"), F.lit(STEPS)).cast("float")
    place = F.array("y_a", "x_a", "y_b", "x_b", F.exp(F.col("scale_b") - F.col("scale_a")).cast("float"), turn)
    sets = match.groupBy("a", "b").agg(F.collect_set(place).alias("m")).where(F.size("m") >= CONSENSUS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
            values = batch.column(2).flatten().flatten().to_numpy().reshape(-1, 6).astype(float)
            yes = [agree(*values[i:j].T) for i, j in zip(ends, ends[1:], strict=False)]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return sets.mapInArrow(rows, "a long, b long")


def linked_images(points: DataFrame) -> DataFrame:
    """Links (a, b) with the same components as all pairs of images that have enough keypoints in agreement."""
    tables = F.array(*[F.xxhash64(F.lit(i), *[F.col("words")[p] for p in chosen]) for i, chosen in enumerate(combinations(range(BITS // 32), EQUAL_WORDS))])
    keyed = points.select(*COLUMNS, F.explode(tables).alias("key"))
    # Only keys and ids are shuffled to find the buckets that two images share; where those are few, Spark broadcasts them to the keypoints.
    ends = keyed.groupBy("key").agg(F.min("media_id").alias("first"), F.max("media_id").alias("last")).where("first <> last").drop("last")
    ends = stage(ends, "shared-keys")
    shared = stage(keyed.join(ends, "key").distinct(), "shared-words")
    release(ends)

    def named(rows: DataFrame, side: str) -> DataFrame:
        return rows.select("key", *[F.col(k).alias(side if k == "media_id" else f"{k}_{side}") for k in COLUMNS])

    match = named(shared.where("media_id = first"), "a").join(named(shared.where("media_id <> first"), "b"), "key")
    groups = components(stage(agreed(match.drop("key")), "image-links"))

    # Images of different groups meet only in buckets with several groups. First they meet the one of a larger group that has most words
    # there, which joins what is left of large groups; then all that can still be linked.
    rows = open_words(shared, groups)
    release(shared)
    found = stage(agreed(met(rows, leading(rows))), "leader-links")
    # A group's members with its root stand for the links found so far.
    groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))
    before, rows = rows, open_words(rows, groups)
    release(before)
    return groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(agreed(met(rows, rows)))


def open_words(words: DataFrame, groups: DataFrame) -> DataFrame:
    """Of words (key, COLUMNS) those of buckets with several groups: with root, n (the group's images in all buckets), largest (the root of
    the bucket's group that is largest by n) and parts.
    """
    members = groups.union(groups.select("root", "root")).distinct()
    members = members.join(groups.groupBy("root").agg((F.count("*") + 1).alias("n")), "root")
    grouped = words.select("key", *COLUMNS).join(members, F.col("media_id") == F.col("node"), "left")
    grouped = stage(grouped.select("key", *COLUMNS, F.coalesce("root", "media_id").alias("root"), F.coalesce("n", F.lit(1)).alias("n")), "grouped-words")
    sizes = grouped.groupBy("key", "root", "n").agg(F.count("*").alias("rows"))
    buckets = sizes.groupBy("key").agg(F.count("*").alias("groups"), F.max_by("root", F.struct("n", "root")).alias("largest"), F.ceil(F.sum("rows") / MEMBERS).cast("int").alias("parts"))
    rows = stage(grouped.join(buckets.where("groups > 1").drop("groups"), "key"), "open-words")
    release(grouped)
    return rows


def leading(rows: DataFrame) -> DataFrame:
    """The rows of each group's image with most of them."""
    most = rows.groupBy("root", "media_id").agg(F.count("*").alias("k")).groupBy("root").agg(F.max_by("media_id", F.struct("k", "media_id")).alias("media_id"))
    return rows.join(most.select("media_id"), "media_id", "left_semi")


def met(rows: DataFrame, others: DataFrame) -> DataFrame:
    """The matches of images (rows) with those of larger groups (others, of equal groups the higher root's) that can be linked.

    Of two groups it is the same in all buckets whose images meet the other's, so a pair has all its matches here. A link takes
    CONSENSUS places: an image with fewer that meet any image of a group is linked with none of them, and doesn't meet them one by one.
    """
    part = {"a": F.pmod(F.xxhash64("media_id"), F.col("parts")).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}
    side = lambda df, s, *more: df.select("key", part[s].alias("part"), *[F.col(k).alias({"media_id": s}.get(k, f"{k}_{s}")) for k in (*COLUMNS, "root", "n", *more)])
    a, b = side(rows.where("root <> largest"), "a"), side(others, "b")
    groups = b.select("key", "part", "root_b", "n_b").distinct()
    toward = stage(a.join(groups, ["key", "part"]).where("n_a < n_b or (n_a = n_b and root_a < root_b)").drop("n_a", "root_a", "n_b"), "toward-groups")
    enough = toward.groupBy("a", "root_b").agg(F.size(F.collect_set(F.struct("y_a", "x_a"))).alias("places")).where(F.col("places") >= CONSENSUS)
    both = toward.join(enough.drop("places"), ["a", "root_b"]).join(b.drop("n_b"), ["key", "part", "root_b"])
    # Both sides of a pair are taken in the order of the ids.
    names = {s: [s, *(f"{k}_{s}" for k in COLUMNS[1:])] for s in "ab"}
    pair = [F.when(F.col("a") < F.col("b"), F.col(i)).otherwise(F.col(j)).alias(i) for x, y in ("ab", "ba") for i, j in zip(names[x], names[y], strict=True)]
    return both.select(*pair)


def copies(media: DataFrame) -> DataFrame:
    """media_id, class_id (smallest media_id of its copies), n_links (the other images of its class): one row for each row of media."""
    points = stage(described(media), "keypoints")
    # Of equal pictures the first stands for all.
    shown = points.select("media_id", "picture").distinct()
    same = stage(shown.join(shown.groupBy("picture").agg(F.min("media_id").alias("first")), "picture"), "equal-pictures")
    links = linked_images(points.join(same.where("media_id = first").drop("first"), ["media_id", "picture"], "left_semi"))
    release(points)
    groups = stage(components(links.union(same.select("first", "media_id"))), "image-classes")
    sizes = groups.groupBy(F.col("root").alias("class_id")).agg(F.count("*").alias("n_links"))
    ids = media.select(F.col("media_id").cast("long").alias("media_id"))
    out = ids.join(groups, F.col("media_id") == F.col("node"), "left").select("media_id", F.coalesce("root", "media_id").alias("class_id")).join(sizes, "class_id", "left")
    return out.select("media_id", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


#: A picture's rows and columns of cells, a cell's pixels, and the numbers of a vector.
CELLS, CELL, NUMBERS = 16, 3, 64


def pictures(embeddings: DataFrame) -> DataFrame:
    """Images from vectors of NUMBERS numbers: a mosaic of CELLS by CELLS each, and of every fourth a cropped, brightened copy.

    A cell's level is the sum of two of the vector's numbers, another pair for each cell. media_id is twice vec_id, or
    one more for the copy. A vector of another length, or none, has a null image. JVM functions only.
    """
    side, n = CELLS * CELL, CELLS * CELLS
    one = F.array(*[F.lit(k % NUMBERS + 1) for k in range(n)])
    other = F.array(*[F.lit((k * (2 * (k // NUMBERS) + 3) + 11 * (k // NUMBERS) + 7) % NUMBERS + 1) for k in range(n)])
    number = lambda i: F.try_element_at("embedding", i).cast("double")
    level = F.when(F.size("embedding") == NUMBERS, F.zip_with(one, other, lambda i, j: F.greatest(F.lit(0.0), F.least(F.lit(255.0), (number(i) + number(j) + 0.57) * 225))))
    ids = embeddings.select("vec_id", level.alias("level"))

    def drawn(rows: DataFrame, key: Column, x0: int, y0: int, w: int, h: int, gain: float, more: float) -> DataFrame:
        # The grid rows as hexadecimal text, one pixel row each; a pixel row is cut from it and repeated.
        text = F.array_join(F.transform("level", lambda v: F.repeat(F.lpad(F.hex(F.floor(v * gain + more).cast("long")), 2, "0"), F.lit(CELL))), "")
        lines = [F.repeat(F.substring("text", 2 * (r * side + x0) + 1, 2 * w), F.lit(k)) for r in range(CELLS) if (k := len(range(max(y0, r * CELL), min(y0 + h, (r + 1) * CELL))))]
        return rows.select(key.alias("media_id"), text.alias("text")).select("media_id", F.lit(w).alias("width"), F.unhex(F.concat(*lines)).alias("image"))

    whole = drawn(ids, 2 * F.col("vec_id"), 0, 0, side, side, 1.0, 0.0)
    return whole.union(drawn(ids.where("vec_id % 4 = 0"), 2 * F.col("vec_id") + 1, 3, 2, side - 4, side - 4, 0.9, 10.0))
