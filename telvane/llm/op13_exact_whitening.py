"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

An entry c becomes the integer floor(64 c) + 1000000. With n vectors of sum S, the scatter n sum(x x') - S S' = n**2 V
is an integer matrix; it is summed exactly over all rows, by partial sums per task.

1. The characteristic polynomial modulo one 31-bit prime after another: reduction to Hessenberg form, then its
   recurrence. Each task takes some primes. As eigenvalues are not negative, coefficients are bounded by the trace
   (Maclaurin), which gives the number of primes; Chinese remaindering restores the integers.
2. All roots are real, so the sign changes of the polynomial shifted to a count the roots beyond a (Descartes' rule is
   exact then). Bisection at dyadic points isolates the largest roots, with multiplicity, and signs at midpoints refine
   them to ``ROOT_BITS`` bits. Roots closer than that are taken as one repeated root.
3. Each root's eigenvectors come from inverse iteration on the nearly singular matrix with ``DIGITS`` decimal digits,
   as many starts as the root's multiplicity, orthonormalised; each task takes some roots.

Only matrices of the vectors' width meet on the driver. Rows are then projected where they are.

Dropped: null vectors, vectors with null, NaN or infinite entries, empty ones, and those whose length is not the most
frequent one (the larger on ties). Floors beyond +-2**40 count as that. Eigenvalues of zero have no component, so there
may be fewer components than asked; without spread there is no row. Equal rows and ids count separately. Columns other
than the id and the vector are ignored. A deviation that passes 64 bits is null.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ROOT_BITS, DIGITS, FAR = 220, 90, float(1 << 40)
OUT = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- rows -------------------------------------------------------------------------------------------------------------

def usable(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the vectors that count, and their length."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    good = rows.select("vec_id", x.alias("x")).where(F.coalesce(finite, F.lit(False)) & (F.size("x") > 0))
    sizes = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = int(sizes["d"]) if sizes else 0
    return good.where(F.size("x") == width), width


def floors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """floor(64 c) of a batch as integers held in doubles, a row per vector."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(64.0 * flat), -FAR, FAR).reshape(batch.num_rows, width)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b for integers held in doubles, as Python integers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, len(a))
    if bound < 2**53:
        return (a.T @ b).astype(np.int64).astype(object)
    # Three limbs of 14 bits each keep every partial product exact.
    limbs = [[np.floor(m / 2.0**s) - np.floor(m / 2.0 ** (s + 14)) * 2.0**14 if s < 28 else np.floor(m / 2.0**s) for s in (0, 14, 28)] for m in (a, b)]
    out = np.zeros((a.shape[1], b.shape[1]), object)
    for i, p in enumerate(limbs[0]):
        for j, q in enumerate(limbs[1]):
            out = out + (p.T @ q).astype(np.int64).astype(object) * (1 << (14 * (i + j)))
    return out


def scatter(good: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of floors, and the integer scatter matrix; sums of tasks meet in a grouped sum of decimals."""
    at = np.triu_indices(width)
    rows, columns = at[0].astype(np.int32), at[1].astype(np.int32)

    def run(batches):
        n, total, square = 0, np.zeros(width, object), np.zeros(len(rows), object)
        for batch in batches:
            if batch.num_rows:
                y = floors(batch, width)
                n += len(y)
                total = total + exact_product(np.ones((len(y), 1)), y)[0]
                square = square + exact_product(y, y)[at]
        if n:
            i = np.r_[rows, np.full(width, -1), -2].astype(np.int32)
            j = np.r_[columns, np.arange(width), 0].astype(np.int32)
            v = [Decimal(int(x)) for x in [*square, *total, n]]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v, pa.decimal128(38, 0))], names=["i", "j", "v"])

    sums = good.select("x").mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = {(r["i"], r["j"]): int(r["v"]) for r in sums.collect()}  # width * (width + 3) / 2 + 1 rows
    n = found.get((-2, 0), 0)
    s = [found.get((-1, j), 0) for j in range(width)]
    m = [[n * found.get((min(i, j), max(i, j)), 0) - s[i] * s[j] for j in range(width)] for i in range(width)]
    return n, s, m


# --- characteristic polynomial ----------------------------------------------------------------------------------------

def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all 32-bit numbers."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2**31, from above, whose product passes the bound."""
    out, product, p = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_modulo(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo p, constant first: Hessenberg form by eliminations, then its recurrence."""
    a = np.array([[v % p for v in row] for row in matrix], np.int64)
    d = len(a)
    for k in range(d - 2):
        at = np.flatnonzero(a[k + 1 :, k])
        if not len(at):
            continue
        i = k + 1 + int(at[0])
        a[[i, k + 1]] = a[[k + 1, i]]
        a[:, [i, k + 1]] = a[:, [k + 1, i]]
        f = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - f[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * f % p).sum(1)) % p
    chain = np.zeros((d + 1, d + 1), np.int64)
    chain[0, 0] = 1
    for k in range(d):
        grown = np.r_[0, chain[k, :-1]] - a[k, k] * chain[k] % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(a[i + 1, i]) % p
            if not below:
                break
            grown -= int(a[i, k]) * below % p * chain[i] % p
        chain[k + 1] = grown % p
    return chain[d]


def in_tasks(spark, table: list[tuple], schema: str, run, out: str) -> list:
    """Rows of ``run`` over a small table, dealt to as many tasks as there are cores."""
    parts = max(1, min(len(table), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(table)], f"at int, {schema}")
    return rows.repartitionByRange(parts, "at").mapInArrow(run, out).collect()


def characteristic(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), constant first, for a matrix without negative eigenvalues."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_beyond(bound)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches):
        for batch in batches:
            found = [polynomial_modulo(shared.value, p) for p in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], names=["p", "r"])

    # The k-th elementary symmetric function of the eigenvalues is (-1)**k times the coefficient, and not negative.
    sums, modulus = [0] * (d + 1), 1
    for row in in_tasks(spark, [(p,) for p in primes], "p long", run, "p long, r array<long>"):
        p, inverse = row["p"], pow(modulus, -1, row["p"])
        for i, r in enumerate(row["r"]):
            r = r if (d - i) % 2 == 0 else -r
            sums[i] += modulus * ((r - sums[i]) * inverse % p)
        modulus *= p
    return [s if (d - i) % 2 == 0 else -s for i, s in enumerate(sums)]


# --- roots ------------------------------------------------------------------------------------------------------------

def scaled(poly: list[int], shift: int) -> list[int]:
    """Coefficients of 2**(shift * degree) poly(x / 2**shift)."""
    top = len(poly) - 1
    return [c << (shift * (top - i)) for i, c in enumerate(poly)]


def roots_beyond(poly: list[int], at: int, shift: int) -> int:
    """How many roots exceed at / 2**shift, counted with multiplicity; exact, as all roots are real."""
    c = scaled(poly, shift)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(poly: list[int], at: int, shift: int) -> int:
    """Sign of poly(at / 2**shift), by Horner's rule on integers."""
    value, power = 0, 0
    for c in reversed(poly):
        value = value * at + (c << power)
        power += shift
    return (value > 0) - (value < 0)


def refine(poly: list[int], lo: int, hi: int, shift: int, bits: int) -> tuple[int, int]:
    """A simple root in (lo, hi] / 2**shift as (numerator, shift), to relative precision 2**-bits."""
    upper = sign_at(poly, hi, shift)
    if not upper:
        return hi, shift
    while hi - lo > 1 or lo.bit_length() < bits:
        if hi - lo == 1:
            lo, hi, shift = 2 * lo, 2 * hi, shift + 1
        mid = (lo + hi) // 2
        s = sign_at(poly, mid, shift)
        if not s:
            return mid, shift
        lo, hi = (lo, mid) if s == upper else (mid, hi)
    return lo + hi, shift + 1


def largest_roots(poly: list[int], count: int, bits: int = ROOT_BITS) -> list[tuple[int, int, int]]:
    """(numerator, shift, multiplicity) of positive roots, falling, until ``count`` are reached."""
    zeros = next(i for i, c in enumerate(poly) if c)
    poly = poly[zeros:]
    if len(poly) == 1:
        return []
    top = 1 << (-poly[-2]).bit_length()  # above the sum of all roots
    out, found = [], 0
    stack = [(0, top, 0, len(poly) - 1, 0)]  # lo, hi, shift, roots beyond lo, roots beyond hi
    while stack and found < count:
        lo, hi, shift, below, above = stack.pop()
        inside = below - above
        if not inside:
            continue
        if inside == 1:
            out.append((*refine(poly, lo, hi, shift, bits), 1))
            found += 1
        elif hi - lo == 1 and lo.bit_length() >= bits:
            out.append((lo + hi, shift + 1, inside))
            found += inside
        else:
            if hi - lo == 1:
                lo, hi, shift = 2 * lo, 2 * hi, shift + 1
            mid = (lo + hi) // 2
            split = roots_beyond(poly, mid, shift)
            stack += [(lo, mid, shift, below, split), (mid, hi, shift, split, above)]  # the upper half first
    return out


# --- components -------------------------------------------------------------------------------------------------------

def null_vectors(matrix: list[list[int]], numerator: int, shift: int, multiplicity: int) -> list[list[float]]:
    """Orthonormal eigenvectors of a root, by inverse iteration from fixed starts."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        root = Decimal(numerator) / (Decimal(2) ** shift)
        a = np.array([[Decimal(v) for v in row] for row in matrix], object)
        for i in range(d):
            a[i, i] -= root
        tiny = root * Decimal(10) ** (5 - DIGITS)
        factors, order = [], []
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            order.append(pivot)
            a[[k, pivot]] = a[[pivot, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            f = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k:] = a[k + 1 :, k:] - np.multiply.outer(f, a[k, k:])
            factors.append(f)
        found = []
        for s in range(multiplicity):
            x = np.array([Decimal((i * 7919 + s * 104729 + 1) % 1009 - 504) + Decimal("0.5") for i in range(d)], object)
            for _ in range(3):
                for k in range(d):
                    x[k], x[order[k]] = x[order[k]], x[k]
                    x[k + 1 :] = x[k + 1 :] - factors[k] * x[k]
                for k in range(d - 1, -1, -1):
                    x[k] = (x[k] - (a[k, k + 1 :] * x[k + 1 :]).sum()) / a[k, k] if k + 1 < d else x[k] / a[k, k]
                for _ in range(2):
                    for v in found:
                        x = x - v * (v * x).sum()
                x = x / (x * x).sum().sqrt()
            found.append(x)
        return [[float(v) for v in x] for x in found]


def components(spark, matrix: list[list[int]], count: int) -> tuple[np.ndarray, list[Fraction]]:
    """Unit eigenvectors (a column each) and eigenvalues of the largest roots, at most ``count``."""
    roots = largest_roots(characteristic(spark, matrix), count)
    if not roots:
        return np.zeros((len(matrix), 0)), []
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches):
        for batch in batches:
            at, vectors = [], []
            for row in batch.to_pylist():
                for v in null_vectors(shared.value, int(row["top"]), row["shift"], row["many"]):
                    at.append(row["at"])
                    vectors.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(vectors, pa.list_(pa.float64()))], names=["at", "v"])

    rows = in_tasks(spark, [(str(a), s, m) for a, s, m in roots], "top string, shift int, many int", run, "at int, v array<double>")
    rows = sorted(rows, key=lambda r: r["at"])[:count]
    values = [Fraction(roots[r["at"]][0], 1 << roots[r["at"]][1]) for r in rows]
    return np.array([r["v"] for r in rows]).T, values


# --- whitening --------------------------------------------------------------------------------------------------------

def centred(y: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n x - S as integers (64 bits where they are wide enough, else Python's), and divided by n."""
    bound = max([n * int(np.abs(y).max(initial=0)), *map(abs, sums), 1])
    kind = np.int64 if 2 * bound < 2**62 else object
    d = y.astype(np.int64).astype(kind) * n - np.array(sums, kind)
    return d, (d / n).astype(np.float64)


def whiten(rows: DataFrame, count: int = 32, vector: str = "embedding") -> DataFrame:
    """The whitened coordinates of every vector on the ``count`` largest components, a row per vector and component."""
    spark = rows.sparkSession
    schema = OUT.format(id=dict(rows.dtypes)["vec_id"])
    good, width = usable(rows, vector)
    n, sums, matrix = scatter(good, width) if width else (0, [], [])
    vectors, values = components(spark, matrix, count) if n else (np.zeros((0, 0)), [])
    if not values:
        return spark.createDataFrame([], schema)
    total = sum(matrix[i][i] for i in range(width))
    scale = np.array([float(v / (n * n)) ** 0.5 for v in values])
    explained = np.array([float(v / total) for v in values])
    k = len(values)

    def moments(batches):
        """Sums of the whitened values and their products, per task."""
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = centred(floors(batch, width), n, sums)[1] @ vectors / scale
                total += np.r_[w.T @ w, w.sum(0)[None]]
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    m = np.zeros((k + 1, k))
    for r in good.select("x").mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        m[r["i"], r["j"]] = r["v"] / n
    error = float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())

    def project(batches):
        for batch in batches:
            y = floors(batch, width)
            d, x = centred(y, n, sums)
            most = int(np.abs(d).max(initial=0))
            if d.dtype == object or width * most * most >= 2**63:
                squares = [v if v < 2**63 else None for v in (d.astype(object) ** 2).sum(1)]
                deviation = pa.array(squares, pa.int64())
            else:
                deviation = pa.array((d * d).sum(1), pa.int64())
            at = pa.array(np.repeat(np.arange(len(y)), k))
            size = len(y) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1), len(y)), pa.int32()), pa.array(np.full(size, n)), deviation.take(at),
                 pa.array((x @ vectors / scale).ravel()), pa.array(np.tile(explained, len(y))), pa.array(np.full(size, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return good.mapInArrow(project, schema)
