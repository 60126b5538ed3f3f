"""Whitening of embeddings: exact scatter from bit planes, then eigenvectors."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

STEPS = 256       # steps of the integer grid in a unit
BLOCK = 4096      # rows whose bits are packed at once, 64 words a plane
TOGETHER = 512    # planes met at once
LIMBS = 5         # 32-bit parts of a sum; only the highest has a sign
HELD = 2**63
_LIMB = [f"l{i}" for i in range(LIMBS)]


def grid(vector, steps: int = STEPS):
    """The entries as longs, floor(steps * c). Null for a vector that is null, empty,
    or holds null or non-finite entries; beyond the range of a long, its end."""
    c = vector.cast("array<double>")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(c, lambda x: F.floor(x * F.lit(float(steps))) + F.lit(0).cast("long")))


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of unsigned columns: words (planes x words of 64 rows), and the
    dimension and the bit of each plane. Bits that no entry of a column has are left out."""
    rows = -(-len(y) // 64) * 64
    words, dimension, bit = [], [], []
    for d, top in enumerate(y.max(axis=0)):
        for b in range(int(top).bit_length()):
            ones = np.zeros(rows, np.uint8)
            ones[:len(y)] = (y[:, d] >> np.uint64(b)) & np.uint64(1)
            words.append(np.packbits(ones).view(np.uint64))
            dimension.append(d)
            bit.append(b)
    return np.array(words, np.uint64).reshape(len(words), rows // 64), np.array(dimension, np.int64), np.array(bit, np.int64)


def products(y: np.ndarray) -> np.ndarray:
    """Sums over rows of the products of every two unsigned columns, d x d Python
    integers: 2^(a+b) times the rows that have both bit a of one and bit b of the other."""
    size = y.shape[1]
    words, dimension, bit = planes(y)
    out = np.zeros((size, size), object)
    if not len(words):
        return out
    # where every weighted count fits a long, so do the sums of a pair of columns
    plain = 2 * (int(bit.max()) + 1) + len(y).bit_length() < 62
    kind = np.int64 if plain else object
    weight = np.array([1 << int(b) for b in bit], kind)
    total = np.zeros((size, size), kind)
    firsts, starts = np.unique(dimension, return_index=True)
    ends = np.append(starts[1:], len(dimension))
    for d, start, end in zip(firsts, starts, ends):
        for at in range(start, len(words), TOGETHER):
            part = slice(at, at + TOGETHER)
            both = np.bitwise_count(words[start:end, None] & words[None, part]).sum(axis=2, dtype=np.int64)
            weighted = (weight[start:end, None] * both.astype(kind)).sum(axis=0) * weight[part]
            np.add.at(total, (d, dimension[part]), weighted)
    upper = np.triu(total)
    return (upper + np.triu(total, 1).T).astype(object)


class Scatter:
    """n, sums and cross-products of integer vectors of one length, exact."""

    def __init__(self, size: int):
        self.n, self.sums, self.cross = 0, np.zeros(size, object), np.zeros((size, size), object)

    def add(self, x: np.ndarray) -> None:
        low = x.min(axis=0)
        y = x.view(np.uint64) - low.view(np.uint64)  # below 2^64 for any two longs
        shift, k = low.astype(object), len(x)
        if int(y.max()).bit_length() + k.bit_length() < 64:
            sums = y.sum(axis=0).astype(object)
        else:
            sums = y.astype(object).sum(axis=0)
        self.n += k
        self.sums = self.sums + sums + k * shift
        self.cross = self.cross + products(y) + np.outer(sums, shift) + np.outer(shift, sums) + k * np.outer(shift, shift)

    def cells(self) -> pd.DataFrame:
        """A row per number: (size, i, j, parts); i = j = -1 is n, j = -1 the sums."""
        size = len(self.sums)
        i, j = np.triu_indices(size)
        every = np.concatenate([[self.n], self.sums, self.cross[i, j]])
        out = {"size": size, "i": np.concatenate([[-1], np.arange(size), i]), "j": np.concatenate([[-1], np.full(size, -1), j])}
        for k, name in enumerate(_LIMB):
            out[name] = [int(v >> 32 * k) & 0xFFFFFFFF if k < LIMBS - 1 else int(v >> 32 * k) for v in every]
        return pd.DataFrame(out)


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, vectors) for each length among the integer vectors."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    lengths = np.diff(ends)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield int(size), at, values[ends[at][:, None] + np.arange(size)]


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, Scatter] = {}
    for batch in batches:
        for size, _, x in _matrices(batch.column("x")):
            held = sums.setdefault(size, Scatter(size))
            for start in range(0, len(x), BLOCK):
                held.add(np.ascontiguousarray(x[start:start + BLOCK]))
    for held in sums.values():
        yield pa.RecordBatch.from_pandas(held.cells(), preserve_index=False)


def axes(n: int, sums: list[int], cross: list[list[int]], keep: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(components, eigenvalues, trace) of the covariance with divisor n, largest first.
    n * cross - sums sums' is centred as integers; one rounding leads to the matrix."""
    size, whole = len(sums), n * n
    v = np.array([[(n * cross[i][j] - sums[i] * sums[j]) / whole for j in range(size)] for i in range(size)], np.float64)
    scale = float(np.abs(v).max()) or 1.0
    values, vectors = np.linalg.eigh(v / scale)
    order = np.argsort(-values, kind="stable")[:keep]
    return vectors[:, order].T.copy(), values[order] * scale, float(np.trace(v / scale)) * scale


def _fit(keep: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows["size"].iloc[0])
        every = [sum(int(part) << 32 * k for k, part in enumerate(parts)) for parts in rows[_LIMB].itertuples(index=False)]
        n, sums, cross = 0, [0] * size, [[0] * size for _ in range(size)]
        for i, j, value in zip(rows["i"], rows["j"], every):
            if i < 0:
                n = value
            elif j < 0:
                sums[i] = value
            else:
                cross[i][j] = cross[j][i] = value
        found, values, trace = axes(n, sums, cross, keep)
        return pd.DataFrame({"size": [size], "n": [n], "sums": [[str(s) for s in sums]], "components": [found.ravel()], "values": [values], "trace": [trace]})

    return fit


class Whitener:
    """Projects integer vectors of one length."""

    def __init__(self, model):
        self.n, self.trace = model["n"], model["trace"]
        self.sums = np.array([int(s) for s in model["sums"]], object)
        self.values = np.array(model["values"])
        self.components = np.array(model["components"]).reshape(-1, model["size"])
        # what rounding leaves of an eigenvalue of 0 is no direction
        self.usable = self.values > max(self.trace, 0.0) * 1e-13
        self.mean = np.array([int(s) // self.n for s in self.sums], object)
        self.rest = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, self.mean)], np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """x - S/n on each component over sqrt(e); nan where e is 0."""
        if np.abs(x.astype(np.float64)).max(initial=0.0) < 2**52 and all(abs(m) < 2**52 for m in self.mean):
            centred = (x - self.mean.astype(np.int64)).astype(np.float64) - self.rest
        else:
            centred = (x.astype(object) - self.mean).astype(np.float64) - self.rest
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.usable, centred @ self.components.T / np.sqrt(np.where(self.usable, self.values, 1.0)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n x - S)^2."""
        far = [max(abs(self.n * int(lo) - s), abs(self.n * int(hi) - s)) for lo, hi, s in zip(x.min(axis=0), x.max(axis=0), self.sums)]
        if sum(f * f for f in far) < HELD and self.n * max(abs(int(x.min())), abs(int(x.max()))) < HELD:
            gap = self.n * x - self.sums.astype(np.int64)
            return (gap * gap).sum(axis=1).tolist()
        gap = self.n * x.astype(object) - self.sums
        return list((gap * gap).sum(axis=1))


def whiten(embeddings: DataFrame, keep: int = 4, steps: int = STEPS) -> DataFrame:
    """Whiten embeddings (vec_id, embedding) on their first principal components.

    Entries become longs floor(steps * c). Each distinct integer vector counts
    once. Tasks shift a block of them so that no entry is negative, pack every
    bit of every dimension across rows into 64-bit words, and get all
    cross-products from weighted popcounts of the ANDs of two planes, undoing the
    shift with integers. A task returns one row per pair of dimensions, in 32-bit
    parts that Spark adds without overflow. n * products - sums * sums is centred
    as integers, then rounded once and given to eigh.

    Returns one row per usable row and component 1 to `keep` (fewer for shorter
    vectors): (vec_id, component, n, deviation, whitened, explained,
    identity_error, deviation_exact). deviation is null where it does not fit in a
    long, deviation_exact is its decimal text. identity_error is measured on the
    whitened vectors of the fit list, over the components whose eigenvalue is not
    0; whitened is null on the others, and explained null where there is no variance
    at all. Rows whose vector is null, empty, or holds null or non-finite entries are
    dropped. Vectors of each length are fitted for
    themselves. Rows that repeat and rows without vec_id each get their own result;
    other columns are ignored. The driver holds `keep` + 1 numbers a dimension for
    each length that occurs, and a task the numbers of every two dimensions.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", grid(F.col("embedding"), steps).alias("x")).where("x is not null")
    distinct = written(rows.select("x").distinct(), "grid")
    parts = distinct.mapInArrow(_partials, "size long, i long, j long, " + ", ".join(f"{name} long" for name in _LIMB))
    sums = parts.groupBy("size", "i", "j").agg(*[F.sum(name).alias(name) for name in _LIMB])
    models = written(sums.groupBy("size").applyInPandas(_fit(keep), "size long, n long, sums array<string>, components array<double>, values array<double>, trace double"), "axes")
    fitted = {m["size"]: Whitener(m) for m in models.collect()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the products of every two whitened values, per length."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in _matrices(batch.column("x")):
                w = np.nan_to_num(fitted[size].whitened(x))
                total[size] = total.get(size, 0.0) + np.concatenate([w.sum(axis=0)[None], w.T @ w])
        for size, found in total.items():
            k = found.shape[1]
            i, j = np.divmod(np.arange(found.size), k)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"size": size, "i": i - 1, "j": j, "value": found.ravel()}), preserve_index=False)

    measured = distinct.mapInArrow(spread, "size long, i long, j long, value double").groupBy("size", "i", "j").agg(F.sum("value").alias("value")).collect()
    errors = {}
    for size, model in fitted.items():
        k = len(model.values)
        got = np.zeros((k + 1, k))
        for r in measured:
            if r["size"] == size:
                got[r["i"] + 1, r["j"]] = r["value"] / model.n
        covariance = got[1:] - np.outer(got[0], got[0])
        wanted = np.diag(model.usable.astype(np.float64))
        errors[size] = float(np.abs(covariance - wanted).max()) if model.usable.any() else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in _matrices(batch.column("x")):
                model = fitted[size]
                k = len(model.values)
                far = model.deviations(x)
                w = model.whitened(x).ravel()
                explained = [float(e / model.trace) * bool(u) if model.trace > 0 else None for e, u in zip(model.values, model.usable)]
                times = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(at)).take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(times), model.n, np.int64)), pa.array([far[t] if far[t] < HELD else None for t in times], pa.int64()),
                    pa.array(w, mask=np.isnan(w)), pa.array(explained * len(at), pa.float64()), pa.array([errors[size]] * len(times), pa.float64()),
                    pa.array([str(far[t]) for t in times], pa.string())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(
        project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string")
