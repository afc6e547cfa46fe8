"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

Vectors become integers, the distinct ones are the fit list, and M = n Q - S S' (n vectors, their sums S, their products Q) is n^2 times their
covariance, without rounding. Its characteristic polynomial is found modulo 31-bit primes (Hessenberg reduction, one prime at a time in tasks) and
put together by Chinese remainders; a bound on the coefficients of a matrix without negative eigenvalues says how many primes are needed. All
roots are real, so Descartes' rule counts those beyond a point exactly, and bisection isolates the largest ones to 200 bits. Components are
null vectors of M - root, by inverse iteration in decimals of 150 digits; equal roots give an orthonormal basis of their space.

Work that grows with the rows runs in Spark: the distinct integer vectors (packed, combined before the exchange, so that copies cost
nothing), their products as sums of 32-bit limbs, and the whitened covariance. Driver and tasks otherwise hold matrices of the dimension only.

Rows whose vector is null or holds a null, NaN or infinity are left out. The vectors' dimension is the most frequent one among the other rows (then the
largest); rows of another dimension are no points of that space and are left out too. Entries beyond 64 bits become the nearest 64-bit integer. Only
components with a positive eigenvalue exist: a table of equal vectors, of one vector or of empty ones gives no rows, as an empty table does.
A squared deviation beyond 64 bits is null. Repeated rows stay rows, a null id is an id like any other, extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import drop_table, map_rows, read, table

SCALE, LIMBS, ROOT_BITS, DIGITS = 256, 5, 200, 150
_WIDTHS = (1, 2, 4, 8)
_MOST = (1 << 63) - 1


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 c) as 64-bit integers, the nearest of them beyond their range."""
    with np.errstate(over="ignore"):
        v = np.floor(values * SCALE)
    high, low = v >= 2.0**63, v < -(2.0**63)
    out = np.where(high | low, 0.0, v).astype(np.int64)
    out[high], out[low] = _MOST, -_MOST - 1
    return out


def packed(rows: np.ndarray) -> list[bytes]:
    """Integer vectors as bytes: the width of an entry, then entries of the smallest width that holds all of a row."""
    low, high = rows.min(1, initial=0), rows.max(1, initial=0)
    width = np.full(len(rows), 8)
    for w in _WIDTHS[2::-1]:
        width[(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1)] = w
    out: list[bytes] = [b""] * len(rows)
    for w in _WIDTHS:
        at = np.flatnonzero(width == w)
        raw, size, tag = rows[at].astype(f"<i{w}").tobytes(), w * rows.shape[1], bytes([w])
        for k, i in enumerate(at):
            out[i] = tag + raw[k * size : (k + 1) * size]
    return out


def unpacked(data: list[bytes], dimension: int) -> np.ndarray:
    out = np.empty((len(data), dimension), np.int64)
    width = np.array([d[0] for d in data], np.int64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(data[i][1:] for i in at), f"<i{w}").reshape(len(at), dimension)
    return out


def finite(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of the rows whose vector, as doubles, holds finite numbers only."""
    v = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return v.where(F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def _matrices(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each dimension of an array of vectors, as indices and integers."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, integers(vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size))


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct integer vector once: (packed, dimension, copies). Copies within a task are combined before the exchange."""

    def work(batches: Iterator[list[pa.Array]]):
        for (vectors,) in batches:
            for at, x in _matrices(vectors):
                yield [packed(x), [x.shape[1]] * len(at)]

    return map_rows(rows, ["vector"], work, "packed binary, dimension int", arrow=True).groupBy("packed", "dimension").agg(F.count(F.lit(1)).alias("copies"))


def _limbs(value: int) -> list[int]:
    return [(value >> 32 * k) & 0xFFFFFFFF for k in range(LIMBS - 1)] + [value >> 32 * (LIMBS - 1)]


def products(x: np.ndarray) -> list[int]:
    """Sums of the columns, then of the products of each two columns (upper triangle by rows), exactly."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if len(x) * top * top < 1 << 53:
        f = x.astype(np.float64)
        square = [int(v) for v in (f.T @ f)[np.triu_indices(x.shape[1])]]
    else:
        o = x.astype(object)
        square = (o.T @ o)[np.triu_indices(x.shape[1])].tolist()
    return [int(v) for v in x.sum(0, dtype=np.int64 if len(x) * top < 1 << 62 else object)] + square


def scatter(fit: DataFrame, dimension: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and M = n Q - S S' of the fit list. Each task adds up its vectors; the sums of its cells go on as limbs, which are added in Spark."""

    def work(batches: Iterator[list[list]]):
        total, n = [0] * (dimension + dimension * (dimension + 1) // 2), 0
        for (data,) in batches:
            n += len(data)
            total = [a + b for a, b in zip(total, products(unpacked(data, dimension)), strict=True)]
        if n:
            limbs = [_limbs(v) for v in [n, *total]]
            yield [list(range(len(limbs))), *(list(c) for c in zip(*limbs, strict=True))]

    names = [f"limb{k}" for k in range(LIMBS)]
    parts = map_rows(fit, ["packed"], work, "cell int, " + ", ".join(f"{c} long" for c in names))
    cells = {r[0]: sum(v << 32 * k for k, v in enumerate(r[1:])) for r in parts.groupBy("cell").agg(*(F.sum(c).alias(c) for c in names)).collect()}
    n, s = cells[0], [cells[1 + i] for i in range(dimension)]
    m, at = [[0] * dimension for _ in range(dimension)], 1 + dimension
    for i in range(dimension):
        for j in range(i, dimension):
            m[i][j] = m[j][i] = n * cells[at] - s[i] * s[j]
            at += 1
    return n, s, m


def _is_prime(n: int) -> bool:
    """For odd n below 2^31; the three bases decide up to 4 759 123 141."""
    twos = (n - 1 & 1 - n).bit_length() - 1
    for a in (2, 7, 61):
        x = pow(a, n - 1 >> twos, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, from above, whose product is over `bound`."""
    found, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def polynomial_mod(m: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x I - m) modulo the prime p < 2^31, constant first, through the Hessenberg form."""
    d = len(m)
    a = np.array([[v % p for v in row] for row in m], np.int64).reshape(d, d)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        if (i := k + 1 + int(below[0])) != k + 1:
            a[[i, k + 1]] = a[[k + 1, i]]
            a[:, [i, k + 1]] = a[:, [k + 1, i]]
        u = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - u[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * u % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        h = a[:k, k - 1]
        polys[k, 1:] = polys[k - 1, :-1]
        chain, terms = 1, polys[k - 1] * int(h[k - 1]) % p
        for i in range(k - 1, 0, -1):
            chain = chain * int(a[i, i - 1]) % p
            if not chain:
                break
            terms = (terms + polys[i - 1] * (int(h[i - 1]) * chain % p)) % p
        polys[k] = (polys[k] - terms) % p
    return polys[d].tolist()


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """det(x I - m) of an integer matrix without negative eigenvalues, constant first. A coefficient is an elementary symmetric function of the
    eigenvalues, so it is at most C(d, k) (trace / d)^k."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    primes = primes_beyond(2 * max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1)))

    def work(batches: Iterator[list[list]]):
        for (ids,) in batches:
            chosen = [primes[i] for i in ids]
            yield [chosen, [polynomial_mod(m, p) for p in chosen]]

    parts = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    residues = map_rows(spark.range(0, len(primes), 1, parts), ["id"], work, "prime long, residues array<long>").collect()
    product = math.prod(primes)
    total = [0] * (d + 1)
    for p, found in residues:
        weight = product // p * pow(product // p % p, -1, p)
        total = [t + weight * r for t, r in zip(total, found, strict=True)]
    return [t - product if (t := v % product) > product // 2 else t for v in total]


def roots_beyond(poly: list[int], m: int, shift: int) -> int:
    """How many roots, with their multiplicity, are greater than m / 2^shift. For a polynomial with real roots only, the changes of sign after
    moving that point to zero are exactly these (Descartes)."""
    d = len(poly) - 1
    c = [v << shift * (d - i) for i, v in enumerate(poly)]
    if m:
        for i in range(d):
            for j in range(d - 1, i - 1, -1):
                c[j] += m * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign_at(poly: list[int], m: int, shift: int) -> int:
    value, d = 0, len(poly) - 1
    for i in range(d, -1, -1):
        value = value * m + (poly[i] << shift * (d - i))
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], most: int, trace: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """The largest positive roots, falling, at most `most`, each as (m, shift) for m / 2^shift with a relative error under 2^-bits. Roots that no
    bisection parts are equal to that precision."""
    out: list[tuple[int, int]] = []
    for k in range(1, min(most, roots_beyond(poly, 0, 0)) + 1):
        low, high, shift, alone = 0, trace + 1, 0, False  # counts beyond low are k or more, beyond high fewer
        while not low or high - low > low >> bits:
            if high - low == 1:
                low, high, shift = 2 * low, 2 * high, shift + 1
            middle = (low + high) // 2
            if not alone:
                beyond = roots_beyond(poly, middle, shift)
                low, high = (middle, high) if beyond >= k else (low, middle)
                if low and high - low < low >> 4:
                    alone = roots_beyond(poly, low, shift) == k and roots_beyond(poly, high, shift) == k - 1
                    before = _sign_at(poly, low, shift)
            else:  # one simple root is left between the ends: signs suffice
                low, high = (middle, high) if _sign_at(poly, middle, shift) == before else (low, middle)
        out.append((low + high, shift + 1))
    return out


def _factor(m: list[list[int]], root: Decimal) -> tuple[list[list[Decimal]], list[int]]:
    """LU of m - root with partial pivoting; a pivot of nothing becomes the least that the digits can tell."""
    d = len(m)
    a = [[Decimal(v) for v in row] for row in m]
    least = root.scaleb(-DIGITS // 2)
    order = list(range(d))
    for i in range(d):
        a[i][i] -= root
    for k in range(d):
        i = max(range(k, d), key=lambda r: abs(a[r][k]))
        a[i], a[k], order[i], order[k] = a[k], a[i], order[k], order[i]
        if abs(a[k][k]) < least:
            a[k][k] = least
        pivot = a[k]
        for row in a[k + 1 :]:
            if row[k]:
                f = row[k] = row[k] / pivot[k]
                row[k + 1 :] = [x - f * y for x, y in zip(row[k + 1 :], pivot[k + 1 :], strict=True)]
    return a, order


def _solve(lu: list[list[Decimal]], order: list[int], b: list[Decimal]) -> list[Decimal]:
    d, x = len(lu), [b[i] for i in order]
    for i in range(d):
        x[i] -= sum((lu[i][j] * x[j] for j in range(i)), Decimal(0))
    for i in range(d - 1, -1, -1):
        x[i] = (x[i] - sum((lu[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / lu[i][i]
    return x


def components(m: list[list[int]], roots: list[tuple[int, int]]) -> list[tuple[Decimal, list[float]]]:
    """(eigenvalue, unit eigenvector) for each root. Each start has no part in the vectors found before, nor has what it becomes, so equal
    roots give different vectors at right angles."""
    d, done, out = len(m), [], []
    with localcontext() as context:
        context.prec, context.Emax, context.Emin = DIGITS, 10**9, -(10**9)

        def unit(v: list[Decimal]) -> list[Decimal]:
            for _ in range(2):
                for w in done:
                    part = sum((a * b for a, b in zip(v, w, strict=True)), Decimal(0))
                    v = [a - part * b for a, b in zip(v, w, strict=True)]
                size = sum((a * a for a in v), Decimal(0)).sqrt()
                v = [a / size for a in v]
            return v

        for top, shift in roots:
            root = Decimal(top) / Decimal(1 << shift)
            lu, order = _factor(m, root)
            v = unit([Decimal(1 + pow(5, i + 1 + 997 * len(done), 65537)) for i in range(d)])
            for _ in range(8):
                w = unit(_solve(lu, order, v))
                moved = min(max(abs(a - b) for a, b in zip(v, w, strict=True)), max(abs(a + b) for a, b in zip(v, w, strict=True)))
                v = w
                if moved < Decimal(10) ** -40:
                    break
            done.append(v)
            out.append((root, [float(a) for a in v]))
    return out


class Whitening:
    """A fitted whitening: n and S of the fit list, the components' eigenvalues of M and vectors, and the trace of M."""

    def __init__(self, n: int, sums: list[int], eigenvalues: list[Decimal], vectors: list[list[float]], trace: int) -> None:
        self.n, self.sums, self.trace = n, sums, trace
        self.vectors = np.array(vectors, np.float64).reshape(len(eigenvalues), len(sums)).T
        self.roots = np.array([float(v.sqrt()) for v in eigenvalues])
        self.explained = [float(v / trace) for v in eigenvalues]
        self.identity_error = 0.0

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """n x - S as doubles, and the exact sums of its squares."""
        s, top = np.array(self.sums, object), max(int(x.max(initial=0)), -int(x.min(initial=0)))
        far = self.n * top + max(abs(v) for v in self.sums)
        if far * far * max(1, len(s)) < 1 << 63:
            y = self.n * x - s.astype(np.int64)
            return y.astype(np.float64), (y * y).sum(1).tolist()
        y = self.n * x.astype(object) - s
        return y.astype(np.float64), [v if v <= _MOST else None for v in (y * y).sum(1).tolist()]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return y @ self.vectors / self.roots


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity; Spark's covariance centres before it multiplies."""
    k = len(model.roots)

    def work(batches: Iterator[list[list]]):
        for (data,) in batches:
            w = model.whitened(model.deviations(unpacked(data, len(model.sums)))[0])
            yield [w[:, i] for i in range(k)]

    rows = map_rows(fit, ["packed"], work, ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[at] - (i == j)) for at, (i, j) in enumerate(pairs))


def fit_whitening(df: DataFrame, most: int = 4, vector: str = "embedding") -> Whitening | None:
    """Fit on the distinct integer vectors of a table; None where no component has a positive eigenvalue."""
    spark = df.sparkSession
    fit = table(fit_list(finite(df, vector, vector)), "fit-list")
    most_frequent = fit.groupBy("dimension").agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("dimension")).first()
    model = None
    if most_frequent and (dimension := most_frequent["dimension"]):
        fitted = fit.where(F.col("dimension") == dimension)
        n, s, m = scatter(fitted, dimension)
        if trace := sum(m[i][i] for i in range(dimension)):
            found = components(m, largest_roots(characteristic_polynomial(spark, m), most, trace))
            model = Whitening(n, s, [e for e, _ in found], [v for _, v in found], trace)
            model.identity_error = _identity_error(fitted, model)
    drop_table(fit)
    return model


def whiten(df: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each row of the model's dimension and each component."""
    kind = df.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = finite(df, key, vector)
    if model is None:
        return df.sparkSession.createDataFrame([], ddl)
    dimension, k = len(model.sums), len(model.roots)

    def work(batches: Iterator[list[pa.Array]]):
        for keys, vectors in batches:
            for at, x in _matrices(vectors):
                if x.shape[1] == dimension:
                    y, deviation = model.deviations(x)
                    named = keys.take(pa.array(np.repeat(at, k)))
                    yield [named, np.tile(np.arange(1, k + 1), len(at)), [model.n] * (k * len(at)), [v for v in deviation for _ in range(k)], model.whitened(y).ravel(), model.explained * len(at), [model.identity_error] * (k * len(at))]

    return map_rows(rows, ["key", "vector"], work, ddl, arrow=True)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the four strongest components of their distinct integer vectors."""
    vectors = read(spark, sf_dir, "embeddings")
    return whiten(vectors, fit_whitening(vectors))
