"""The seam where a model is asked, and picture kernels over raw pixels. Arrow batches throughout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.functions import probs as P


def answered(df: DataFrame, probs: str = "probabilities") -> DataFrame:
    """``df`` with prediction (first of equals), its probability and the confidence above chance."""
    p = F.col(probs)
    top = F.array_max(F.transform(p, lambda e: e["p"]))
    return df.withColumns({"prediction": P.argmax_key(p), "p_prediction": top, "confidence": P.confidence(top, F.size(p))})


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """An array of logits as probabilities at a temperature."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    e = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def asked(df: DataFrame, key: str, columns: list[str], load: Callable[[], Callable[[list[dict]], list[list[float]]]]) -> DataFrame:
    """(key, logits, error) of every row. ``load`` runs once per Python worker and gives a function of a
    batch of rows; a batch that fails is asked row by row, so that one bad row costs only itself."""
    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [key])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            rows = batch.to_pylist()
            try:
                out, errors = model(rows), [None] * len(rows)
            except Exception:  # noqa: BLE001
                out, errors = [], []
                for r in rows:
                    try:
                        out.append(model([r])[0])
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        out.append(None)
                        errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64())), pa.array(errors, pa.string())], [key, "logits", "error"])

    return df.select(key, *(c for c in columns if c != key)).mapInArrow(ask, f"{types}, logits array<double>, error string")


def asked_once(df: DataFrame, key: str, columns: list[str], load) -> DataFrame:
    """As :func:`asked`, each distinct combination of ``columns`` asked once and joined back."""
    d = df.withColumn("_k", F.sha2(F.to_json(F.struct(*columns)), 256))
    out = asked(d.dropDuplicates(["_k"]).select("_k", *columns), "_k", columns, load)
    return d.select(key, "_k").join(out, "_k").select(key, "logits", "error")


def _resized(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area means of a grey picture on an h x w grid."""
    ys, xs = (np.linspace(0, n, k + 1) for n, k in ((a.shape[0], h), (a.shape[1], w)))
    c = np.pad(a.astype(float).cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def at(y, x):
        y0, x0 = np.minimum(y.astype(int), a.shape[0]), np.minimum(x.astype(int), a.shape[1])
        y1, x1 = np.minimum(y0 + 1, a.shape[0]), np.minimum(x0 + 1, a.shape[1])
        fy, fx = (y - y0)[:, None], (x - x0)[None, :]
        g = lambda p, q: c[np.ix_(p, q)]
        return g(y0, x0) * (1 - fy) * (1 - fx) + g(y1, x0) * fy * (1 - fx) + g(y0, x1) * (1 - fy) * fx + g(y1, x1) * fy * fx

    s = at(ys, xs)
    areas = np.outer(np.diff(ys), np.diff(xs))
    return (s[1:, 1:] - s[:-1, 1:] - s[1:, :-1] + s[:-1, :-1]) / areas


def difference_hash(a: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 cells is darker than its right neighbour."""
    g = _resized(a, 8, 9)
    return int(np.packbits(g[:, 1:] > g[:, :-1]).view(">i8")[0])


def frequency_hash(a: np.ndarray) -> int:
    """64 bits: low cosine frequencies of a 32 x 32 picture against their median."""
    g = _resized(a, 32, 32)
    k = np.arange(32)
    basis = np.cos(np.pi * np.outer(np.arange(8), 2 * k + 1) / 64)
    low = (basis @ g @ basis.T).ravel()
    return int(np.packbits(low > np.median(low[1:])).view(">i8")[0])


def letterboxed(a: np.ndarray, size: int, fill: float = 128.0) -> np.ndarray:
    """A picture (rows, columns, channels or grey) fitted into a square of ``size`` by area means, even margins of ``fill`` around it."""
    h, w = a.shape[:2]
    scale = size / max(h, w)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    planes = a[..., None] if a.ndim == 2 else a
    out = np.full((size, size, planes.shape[2]), float(fill))
    top, left = (size - nh) // 2, (size - nw) // 2
    for c in range(planes.shape[2]):
        out[top : top + nh, left : left + nw, c] = _resized(planes[..., c], nh, nw)
    return out[..., 0] if a.ndim == 2 else out


def view_pixels(a: np.ndarray, views: list[tuple[float, float, float, float]], size: int, fill: float = 128.0) -> np.ndarray:
    """The views (x, y, w, h in pixels) of a picture, each fitted into a square: one array of views."""
    cut = lambda x, y, w, h: a[max(0, int(y)) : max(int(y) + 1, int(np.ceil(y + h))), max(0, int(x)) : max(int(x) + 1, int(np.ceil(x + w)))]
    return np.stack([letterboxed(cut(*v), size, fill) for v in views])


@F.arrow_udf(T.StructType([T.StructField("pixel_sha", T.StringType()), T.StructField("dhash", T.LongType()), T.StructField("phash", T.LongType()), T.StructField("mirror_dhash", T.LongType()), T.StructField("mirror_phash", T.LongType())]))
def pixel_hashes(pixels: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """Hashes of grey pictures given as bytes row by row; null where the bytes do not fill the size."""
    import hashlib

    out = []
    for p, w, h in zip(pixels.to_pylist(), width.to_pylist(), height.to_pylist(), strict=True):
        if p is None or not w or not h or len(p) != w * h:
            out.append(None)
            continue
        a = np.frombuffer(p, np.uint8).reshape(h, w)
        out.append({"pixel_sha": hashlib.sha256(f"{w}x{h}:".encode() + p).hexdigest(), "dhash": difference_hash(a), "phash": frequency_hash(a), "mirror_dhash": difference_hash(a[:, ::-1]), "mirror_phash": frequency_hash(a[:, ::-1])})
    return pa.array(out, pa.struct([("pixel_sha", pa.string()), ("dhash", pa.int64()), ("phash", pa.int64()), ("mirror_dhash", pa.int64()), ("mirror_phash", pa.int64())]))
