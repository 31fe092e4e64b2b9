"""Whitening of embeddings with components from the exact characteristic polynomial.

Vectors are whole numbers (floor of 256 times each component), and each distinct one counts once. Their number, sums and sums of
products are added up exactly, in limbs, so that n times the sum of products less the product of sums, which is n^2 times the
covariance, is an exact matrix of whole numbers. Then

* its characteristic polynomial is found modulo primes, a row of a Spark table each: the matrix is brought to Hessenberg form and
  the polynomial follows by recurrence. As many primes are taken as the coefficients' bound needs; they are joined by Chinese
  remaindering.
* All roots of it are real and none is negative, so by Descartes' rule the sign changes of the polynomial shifted by a count the
  roots above a exactly, repeated ones as often as they occur. The largest roots are isolated so by bisection over binary
  fractions and then narrowed to many more bits than lie between neighbours. Roots nearer to each other than 2^-CLUSTER_BITS of their
  size count as one that is repeated. Zero roots are told by the lowest coefficients and are no components.
* Each root's null space comes from inverse iteration in fixed-point arithmetic of as many bits, again a row of a table each; of a
  repeated root a basis is made orthogonal.

What the driver holds, and its work, is bounded by the dimension (the matrix, the primes' residues, a few roots), whatever the
number of rows. Rows are then centred and projected where they lie.

Defined cases: rows whose vector is null, empty, or has a null or non-finite component are dropped, and so are those of another
length than most rows have or with a component whose whole number does not fit in 63 bits; repeated rows get their rows each;
components with eigenvalue zero are left out, so equal vectors alone, a single row or an empty table give an empty result; a null id
stays null; a deviation that does not fit in 63 bits is null; extra columns are not read.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import read_table, saved
from riskloom.llm.vectors import matrix, whole_vectors

COMPONENTS, CLUSTER_BITS, GUARD_BITS = 4, 256, 128
LIMB, LIMBS = 56, 4
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


@dataclass
class Whitening:
    """n vectors with sums; a component's direction, eigenvalue of the covariance, and share of the trace in each row of the arrays."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def _limbs(value: int) -> list[int]:
    """Digits to the base 2^LIMB, the highest of them with the sign."""
    return [value >> LIMB * k & (1 << LIMB) - 1 for k in range(LIMBS - 1)] + [value >> LIMB * (LIMBS - 1)]


def products(x: np.ndarray) -> np.ndarray:
    """x' x, exactly, as Python's whole numbers: by floating point where every sum stays below 2^53."""
    most = max(abs(int(x.min())), abs(int(x.max())))
    step = (1 << 53) // max(most * most, 1)
    if step < 1:
        return x.astype(object).T @ x.astype(object)
    total = 0
    for at in range(0, len(x), min(step, len(x))):
        part = x[at : at + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _moments(d: int):
    """Rows (cell, limbs) of a task's sums: cell 0 is the number of rows, then d sums, then the products of the upper triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                n, sums, squares = n + len(x), sums + x.astype(object).sum(0), squares + products(x)
        if n:
            cells = [n, *sums, *squares[np.triu_indices(d)]]
            limbs = [_limbs(int(v)) for v in cells]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), *(pa.array(c, pa.int64()) for c in zip(*limbs, strict=True))], ["cell", *(f"l{k}" for k in range(LIMBS))])

    return run


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums, and n^2 times the covariance of the rows of fit (x), all exact."""
    parts = fit.select("x").mapInArrow(_moments(d), "cell int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    added = parts.groupBy("cell").agg(*[F.sum(F.col(f"l{k}").cast("decimal(20,0)")).alias(f"l{k}") for k in range(LIMBS)])
    cells = {r["cell"]: sum(int(r[f"l{k}"]) << LIMB * k for k in range(LIMBS)) for r in added.collect()}
    n, sums = cells[0], [cells[1 + i] for i in range(d)]
    m = [[0] * d for _ in range(d)]
    for cell, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True), 1 + d):
        m[i][j] = m[j][i] = n * cells[cell] - sums[i] * sums[j]
    return n, sums, m


def is_prime(p: int) -> bool:
    """Exact below 3 * 10^9: strong tests to the bases 2, 3, 5, 7."""
    if p < 9 or p % 2 == 0:
        return p in (2, 3, 5, 7)
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        y = pow(base, odd, p)
        if base % p and y not in (1, p - 1) and all((y := y * y % p) != p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(m: list[list[int]]) -> list[int]:
    """Primes whose squares times the dimension fit in 63 bits, and whose product is above twice any coefficient: the k-th of them is
    at most C(d, k) (trace / d)^k, and all together (1 + trace / d)^d."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    bound = 2 * (2 + trace // d) ** d
    found, product, p = [], 1, (1 << (62 - d.bit_length()) // 2) - 1
    while product <= bound:
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def characteristic_mod(m: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(t I - m) modulo p, the lowest first."""
    a = (np.array(m, object) % p).astype(np.int64)
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        if i != k + 1:
            a[[i, k + 1]] = a[[k + 1, i]]
            a[:, [i, k + 1]] = a[:, [k + 1, i]]
        f = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - f[:, None] * a[k + 1]) % p
        a[:, k + 1] = (a[:, k + 1] + a[:, k + 2 :] @ f) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        of_earlier, under = np.zeros(k, np.int64), 1
        of_earlier[k - 1] = a[k - 1, k - 1]
        for j in range(k - 2, -1, -1):
            under = under * int(a[j + 1, j]) % p
            of_earlier[j] = int(a[j, k - 1]) * under % p
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - of_earlier @ polys[:k]) % p
    return polys[d].tolist()


def chinese(residues: dict[int, list[int]]) -> list[int]:
    """The whole numbers, of least size, with these residues."""
    product = math.prod(residues)
    units = {p: product // p * pow(product // p, -1, p) for p in residues}
    found = [sum(residues[p][k] * u for p, u in units.items()) % product for k in range(len(next(iter(residues.values()))))]
    return [v - product if 2 * v > product else v for v in found]


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Exact coefficients of det(t I - m), the lowest first; the primes' work is dealt out over the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            primes = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([characteristic_mod(m, p) for p in primes], pa.list_(pa.int64()))], ["p", "residues"])

    rows = spark.createDataFrame([(p,) for p in primes_for(m)], "p long").mapInArrow(run, "p long, residues array<long>").collect()
    return chinese({r["p"]: r["residues"] for r in rows})


def roots_above(poly: list[int], m: int, bits: int) -> int:
    """How many roots of poly, all of which are real, lie above m / 2^bits: sign changes of the coefficients after the shift."""
    d = len(poly) - 1
    c = [v << bits * (d - k) for k, v in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += m * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign_at(poly: list[int], m: int, bits: int) -> int:
    value = 0
    for k, v in enumerate(reversed(poly)):
        value = value * m + (v << bits * k)
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int, int]]:
    """(m, bits, times): the largest roots, down to the one with which count are reached or all there are that are not zero; each
    is m / 2^bits but for half a unit, and occurs times times. All roots are real, none is negative."""
    while len(poly) > 1 and poly[0] == 0:
        poly = poly[1:]
    d, found, total = len(poly) - 1, [], 0
    top = 1 << max(abs(poly[-2]), 1).bit_length() if d else 1  # their sum is below
    open_ = [(0, top, 0, d, 0)] if d else []  # low, high, bits, roots above low, roots above high; the highest interval last
    while open_ and total < count:
        low, high, bits, above_low, above_high = open_.pop()
        times = above_low - above_high
        if not times:
            continue
        if times == 1 or low and low.bit_length() > CLUSTER_BITS:
            found.append((low, high, bits, times))
            total += times
            continue
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        mid = (low + high) // 2
        above = roots_above(poly, mid, bits)
        open_ += [(low, mid, bits, above_low, above), (mid, high, bits, above, above_high)]
    return [(*narrowed(poly, low, high, bits), times) if times == 1 else (low + high, bits + 1, times) for low, high, bits, times in found]


def narrowed(poly: list[int], low: int, high: int, bits: int) -> tuple[int, int]:
    """(m, bits): the only root above low and up to high, in units of 2^-bits, to GUARD_BITS more binary digits than tell it from others."""
    above = sign_at(poly, high, bits)
    while above and low.bit_length() <= CLUSTER_BITS + GUARD_BITS:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        mid = (low + high) // 2
        sign = sign_at(poly, mid, bits)
        if not sign:
            return 2 * mid, bits + 1
        low, high = (low, mid) if sign == above else (mid, high)
    return (low + high, bits + 1) if above else (2 * high, bits + 1)


def null_space(m: list[list[int]], root: int, bits: int, times: int, seed: int = 7) -> list[list[float]]:
    """Orthogonal unit vectors of the null space of m - root / 2^bits, which has so many dimensions: inverse iteration from random
    vectors, in fixed point with bits + GUARD_BITS binary digits."""
    d, digits = len(m), bits + GUARD_BITS + 64
    a = np.array(m, object) * (1 << digits)
    a[np.arange(d), np.arange(d)] -= root << digits - bits
    steps = []
    for k in range(d):
        i = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
        if i != k:
            a[[i, k]] = a[[k, i]]
        if not a[k, k]:
            a[k, k] = 1
        f = np.array([(int(v) << digits) // int(a[k, k]) for v in a[k + 1 :, k]], object)
        if k + 1 < d:
            a[k + 1 :, k:] -= f[:, None] * a[k, k:] >> digits
        steps.append((i, f))
    rnd = random.Random(seed)
    one, found = 1 << digits, []
    for _ in range(times):
        b = np.array([rnd.getrandbits(40) << digits - 40 for _ in range(d)], object)
        for _ in range(4):
            for v in found:
                b = b - ((b @ v >> digits) * v >> digits)
            b = b * one // math.isqrt(int(b @ b))
            x = b.copy()
            for k, (i, f) in enumerate(steps):
                x[[i, k]] = x[[k, i]]
                x[k + 1 :] -= f * x[k] >> digits
            for k in range(d - 1, -1, -1):
                x[k] = ((int(x[k]) << digits) - int(a[k, k + 1 :] @ x[k + 1 :] if k + 1 < d else 0)) // int(a[k, k])
            most = max(map(abs, x.tolist()))
            b = np.array([(int(v) << digits) // int(most) for v in x], object)
        for v in found:
            b = b - ((b @ v >> digits) * v >> digits)
        found.append(b * one // math.isqrt(int(b @ b)))
    vectors = [[float(Fraction(int(v), one)) for v in b] for b in found]
    return [[v if max(b, key=abs) > 0 else -v for v in b] for b in vectors]


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Components of the rows of vectors (x), each of which counts."""
    spark = vectors.sparkSession
    n, sums, m = scatter(vectors, d)
    roots = largest_roots(characteristic(spark, m), components)
    trace = sum(m[i][i] for i in range(d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([null_space(m, int(r["root"]), r["bits"], r["times"]) for r in rows], pa.list_(pa.list_(pa.float64())))], ["place", "vectors"])

    table = spark.createDataFrame([(k, str(r), b, t) for k, (r, b, t) in enumerate(roots)], "place int, root string, bits int, times int")
    found = {r["place"]: r["vectors"] for r in table.mapInArrow(run, "place int, vectors array<array<double>>").collect()} if roots else {}
    directions, values = [], []
    for k, (root, bits, _) in enumerate(roots):
        for v in found[k]:
            directions.append(v)
            values.append(Fraction(root, 1 << bits))
    values = values[:components]
    return Whitening(n, sums, np.array(directions[:components]).reshape(-1, d), np.array([float(v / n**2) for v in values]), np.array([float(v / trace) for v in values]))


def _project(model: Whitening):
    """(deviation, whitened of every component) of a batch's vectors."""
    sums, scale = np.array(model.sums, object), 1 / np.sqrt(model.values)
    safe = max(map(abs, model.sums), default=0)

    def run(x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        most = model.n * max(abs(int(x.min())), abs(int(x.max()))) + safe
        exact = most * most * x.shape[1] < 1 << 63
        apart = x * model.n - sums.astype(np.int64) if exact else x.astype(object) * model.n - sums
        squares = (apart * apart).sum(1).tolist()
        return [s if s < 1 << 63 else None for s in squares], (apart.astype(np.float64) / model.n) @ model.directions.T * scale

    return run


def _whiten(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, k = _project(model), len(model.values)
        for batch in batches:
            if batch.num_rows:
                deviation, whitened = project(matrix(batch.column(1)))
                each = pa.array(np.repeat(np.arange(batch.num_rows), k))
                component = np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(each), pa.array(component), pa.array(np.full(len(component), model.n)), pa.array(deviation, pa.int64()).take(each), pa.array(whitened.ravel()), pa.array(model.explained[component - 1])], [f.split()[0] for f in RESULT.split(", ")])

    return run


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = _project(model)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*map(pa.array, project(matrix(batch.column(0)))[1].T)], [f"z{k}" for k in range(len(model.values))])

    k = len(model.values)
    z = fit_list.select("x").mapInArrow(run, ", ".join(f"z{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cells = z.agg(*[F.covar_pop(f"z{i}", f"z{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cells, pairs, strict=True))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    table = whole_vectors(rows, vector_col, float(1 << 63), False, vec_id=F.col(id_col).cast("long"))
    first = table.select(F.size("x")).first()
    none = table.select("vec_id").where("false").mapInArrow(lambda batches: iter(()), RESULT)
    if first is None:
        return none.withColumn("identity_error", F.lit(0.0))
    fit_list = saved(table.select("x").distinct(), "fit-list")
    model = fit(fit_list, first[0], components)
    if not len(model.values):
        return none.withColumn("identity_error", F.lit(0.0))
    return table.select("vec_id", "x").mapInArrow(_whiten(model), RESULT).withColumn("identity_error", F.lit(identity_error(fit_list, model)))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
