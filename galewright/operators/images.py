"""Image operators: convolution, pooling, normalisation as NumPy kernels; windows, heat maps and crops as expressions."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewright.operators.prefix import key_bucket, running

# Kernels


def convolve(x: np.ndarray, w: np.ndarray, reverse_y: bool = False, reverse_x: bool = False) -> np.ndarray:
    """Valid correlation of (batch, y, x) by a filter. With ``reverse`` in a direction the output is larger than the input
    there and the filter runs the other way, as in a transposed convolution."""
    pad = [(0, 0), (w.shape[0] - 1,) * 2 if reverse_y else (0, 0), (w.shape[1] - 1,) * 2 if reverse_x else (0, 0)]
    x = np.pad(x, pad)
    w = w[:: -1 if reverse_y else 1, :: -1 if reverse_x else 1]
    return np.einsum("byxij,ij->byx", np.lib.stride_tricks.sliding_window_view(x, w.shape, axis=(1, 2)), w)


def convolve_gradients(x: np.ndarray, w: np.ndarray, out_grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the valid correlation by input and filter."""
    windows = np.lib.stride_tricks.sliding_window_view(x, w.shape, axis=(1, 2))
    return convolve(out_grad, w, True, True), np.einsum("byxij,byx->ij", windows, out_grad)


def pool_sizes(n_in: int, n_out: int, rng: np.random.Generator | None = None) -> np.ndarray:
    """Sizes of ``n_out`` neighbouring pools over ``n_in`` places, as equal as can be, shuffled if there is an ``rng``."""
    sizes = np.full(n_out, n_in // n_out)
    sizes[: n_in % n_out] += 1
    if rng is not None:
        rng.shuffle(sizes)
    return sizes


def max_pool(x: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Max pooling of (batch, y, x) by uneven pools."""
    y0, x0 = np.r_[0, np.cumsum(ys)[:-1]], np.r_[0, np.cumsum(xs)[:-1]]
    return np.maximum.reduceat(np.maximum.reduceat(x, y0, axis=1), x0, axis=2)


def max_pool_gradient(x: np.ndarray, ys: np.ndarray, xs: np.ndarray, out_grad: np.ndarray) -> np.ndarray:
    """The gradient goes to each pool's greatest values, shared among equals."""
    top = np.repeat(np.repeat(max_pool(x, ys, xs), ys, axis=1), xs, axis=2)
    hit = (x == top).astype(float)
    y0, x0 = np.r_[0, np.cumsum(ys)[:-1]], np.r_[0, np.cumsum(xs)[:-1]]
    n = np.add.reduceat(np.add.reduceat(hit, y0, axis=1), x0, axis=2)
    return hit * np.repeat(np.repeat(out_grad / n, ys, axis=1), xs, axis=2)


def averaged_pool(x: np.ndarray, n_y: int, n_x: int, repeats: int, rng: np.random.Generator) -> np.ndarray:
    """Test-time pooling: the mean over several shuffles of the pool sizes."""
    return np.mean([max_pool(x, pool_sizes(x.shape[1], n_y, rng), pool_sizes(x.shape[2], n_x, rng)) for _ in range(repeats)], axis=0)


def clamped_relu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, slope): 0.005 x under 0, at most 5.5."""
    return np.where(x <= 0, 0.005 * x, np.minimum(x, 5.5)), np.where(x <= 0, 0.005, np.where(x > 5.5, 0.0, 1.0))


def batch_norm(x: np.ndarray, gamma: float, beta: float, running: tuple[float, float] | None = None, epsilon: float = 1e-7) -> tuple[np.ndarray, float, float]:
    """Normalised values, and the mean and unbiased variance they were normalised by (the running ones in tests)."""
    n = x.size
    mean, var = running if running else (float(x.mean()), float(x.var() * n / max(1, n - 1)))
    return gamma * (x - mean) / np.sqrt(var + epsilon) + beta, mean, var


def velocity_step(w: np.ndarray, grad: np.ndarray, velocity: np.ndarray, mu: float, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """One step with Nesterov momentum and weight decay; weights stay within +-50."""
    new = mu * velocity - rate * grad
    return np.clip(w - mu * velocity + (1 + mu) * new - decay * w, -50, 50), new


def softmax_rows(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


# Frames


def read_packed_images(data: bytes) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(index, class, channels, height, width, planes) of a packed set: four integers (classes, channels, width, height), the classes'
    sizes, and the planes of each image, class by class."""
    classes, channels, width, height = struct.unpack_from("<4i", data, 0)
    sizes = struct.unpack_from(f"<{classes}i", data, 16)
    at, step, index = 16 + 4 * classes, channels * width * height, 0
    for label, n in enumerate(sizes):
        for _ in range(n):
            yield index, label, channels, height, width, data[at : at + step]
            at, index = at + step, index + 1


def packed_images(spark, path: str) -> DataFrame:
    """The images of packed files as rows; a file is read by one task, image by image."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                out = list(read_packed_images(content))
                for k in range(0, len(out), 1000):
                    part = pd.DataFrame(out[k : k + 1000], columns=["image", "class", "channels", "height", "width", "data"])
                    part.insert(0, "path", name)
                    yield part

    schema = "path string, image int, class int, channels int, height int, width int, data binary"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, schema)


def channel_statistics(df: DataFrame, image: str, channel: str, value: str) -> DataFrame:
    """Per channel: mean, and the root of the mean over images of each image's mean squared deviation from it."""
    per = df.groupBy(channel, image).agg(F.sum(value).alias("__s"), F.sum(F.col(value) * F.col(value)).alias("__q"), F.count(value).alias("__n"))
    mean = per.groupBy(channel).agg((F.sum("__s") / F.sum("__n")).alias("mean"))
    m = F.col("mean")
    off = (F.col("__q") - 2 * m * F.col("__s") + F.col("__n") * m * m) / F.col("__n")
    return per.join(mean, channel).groupBy(channel, "mean").agg(F.sqrt(F.avg(off)).alias("sd"))


def windows(df: DataFrame, height: str, width: str, size: int, stride: int) -> DataFrame:
    """Each image's windows of ``size`` at every ``stride``: columns y and x of the upper left corner."""
    at = lambda c: F.sequence(F.lit(0), F.col(c) - size, F.lit(stride))
    fits = df.where((F.col(height) >= size) & (F.col(width) >= size))
    return fits.withColumn("y", F.explode(at(height))).withColumn("x", F.explode(at(width)))


def heat_map(df: DataFrame, image: str, y: str, x: str, score: str, size: int) -> DataFrame:
    """Scores of windows added over the pixels they cover, over the greatest number of windows on one pixel of the image."""
    span = F.sequence(F.lit(0), F.lit(size - 1))
    spread = df.select(image, y, x, score, F.explode(span).alias("__dy")).withColumn("__dx", F.explode(span))
    pixels = spread.groupBy(image, (F.col(y) + F.col("__dy")).alias("py"), (F.col(x) + F.col("__dx")).alias("px")).agg(F.sum(score).alias("heat"), F.count("*").alias("overlap"))
    most = pixels.groupBy(image).agg(F.max("overlap").alias("__most"))
    return pixels.join(most, image).select(image, "py", "px", (F.col("heat") / F.col("__most")).alias("heat"), "overlap")


def crop_box(y: Column, x: Column, radius: int, height: Column, width: Column) -> tuple[Column, Column, Column, Column]:
    """The box (top, left, bottom, right) around a point, moved inside the image; images smaller than it are taken whole."""
    side = 2 * radius
    top = F.greatest(F.least(y - radius, height - side), F.lit(0))
    left = F.greatest(F.least(x - radius, width - side), F.lit(0))
    return top, left, F.least(top + side, height), F.least(left + side, width)


def locate_subimages(images: DataFrame, image: str, n_y: str, n_x: str, wanted: DataFrame, index: str) -> DataFrame:
    """(index, image, sub_y, sub_x) of global sub-image numbers: images in order have n_y * n_x each. The running counts
    are bucketed, so that the range lookup is an equality on buckets."""
    counted = images.select(image, n_y, n_x, (F.col(n_y) * F.col(n_x)).cast("bigint").alias("__n"), F.lit(1).alias("__all"))
    sized = running(counted, ["__all"], [image], key_bucket(images, image), F.col("__n"), "__end").withColumn("__start", F.col("__end") - F.col("__n")).where("__n > 0")
    step = 1024
    spread = sized.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__start") / step), F.floor((F.col("__end") - 1) / step))))
    asked = wanted.select(index).withColumn("__b", F.floor(F.col(index) / step))
    j = asked.join(spread, "__b").where((F.col(index) >= F.col("__start")) & (F.col(index) < F.col("__end")))
    k = F.col(index) - F.col("__start")
    return j.select(index, image, F.floor(k / F.col(n_x)).alias("sub_y"), (k % F.col(n_x)).alias("sub_x"))


def operations_estimate(filter_y: Column, filter_x: Column, out_y: Column, out_x: Column) -> Column:
    """Multiplications of one convolution, forward."""
    return filter_y * filter_x * out_y * out_x


def classified(df: DataFrame, image: str, k: str, score: str, label: str) -> DataFrame:
    """Per image: the class of greatest score (lowest of equals), whether it is right, and the cross entropy of its softmax."""
    top = df.groupBy(image).agg(F.max(score).alias("top"), F.min_by(k, F.struct(-F.col(score), F.col(k))).alias("predicted"), F.first(label).alias(label))
    lse = df.join(top.select(image, "top"), image).groupBy(image).agg(F.log(F.sum(F.exp(F.col(score) - F.col("top")))).alias("lse"))
    own = df.where(F.col(k) == F.col(label)).select(image, F.col(score).alias("own"))
    j = top.join(lse, image).join(own, image)
    return j.select(image, label, "predicted", (F.col("predicted") == F.col(label)).alias("correct"), (F.col("lse") + F.col("top") - F.col("own")).alias("loss"))
