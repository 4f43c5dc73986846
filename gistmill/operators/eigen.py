"""Leading eigenvectors of a large symmetric operator that is only known by what it does to a table of vectors.

Subspace iteration with a Chebyshev filter. A table holds a number of trial vectors as columns, a row for each place. Each round applies a polynomial of
the operator that stays small on the interval below the trial values and grows fast above it, makes the columns orthonormal through their Gram matrix and turns
them to the best approximations (Rayleigh-Ritz). The round's residuals, measured row by row, decide: the fit ends when all are below the tolerance, and
raises if the rounds run out. Only matrices of the size of the number of columns reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.functions.draws import hash_key
from gistmill.session import cut_lineage

#: Applications of the operator in a round, and how much they may blow up the largest against the least: columns must stay apart.
DEGREE, GROWTH = 20, 1e5
MAX_ROUNDS = 60


def random_columns(rows: DataFrame, key: str, names: Sequence[str], seed: int) -> DataFrame:
    """``names`` as columns of repeatable numbers between -1 and 1, beside all columns of ``rows``."""
    made = [(F.conv(F.substring(hash_key(seed + i, key), 1, 8), 16, 10).cast("double") / 2.0**31 - 1.0).alias(n) for i, n in enumerate(names)]
    return rows.select("*", *made)


def gram(table: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Scalar products of all pairs of columns: added up in each task, then by place of the matrix."""
    n = len(names)
    upper = np.triu_indices(n)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]) if batch.num_rows else np.zeros((n, 0))
            total += x @ x.T
        place = np.arange(len(upper[0]), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[upper])], ["place", "value"])

    sums = table.select(*names).mapInArrow(add, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros((n, n))
    for r in sums.collect():
        out[upper[0][r["place"]], upper[1][r["place"]]] = r["value"]
    return np.triu(out) + np.triu(out, 1).T


def combined(table: DataFrame, names: Sequence[str], mix: np.ndarray, out: Sequence[str], *keep: str) -> DataFrame:
    """Columns ``out`` = columns ``names`` times ``mix``, a product of blocks in the tasks."""
    kinds = ", ".join([*(f"{c} {table.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} double" for c in out)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], 1) @ mix
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x[:, i].copy()) for i in range(len(out)))], [*keep, *out])

    return table.select(*dict.fromkeys([*keep, *names])).mapInArrow(run, kinds)


def orthonormal(table: DataFrame, names: Sequence[str], *keep: str, known: Sequence[str] = ()) -> DataFrame:
    """The columns made orthonormal, and orthogonal to the orthonormal columns ``known``; twice if they were close to each other."""
    for _ in range(2):
        g = gram(table, [*known, *names])
        k = len(known)
        # Columns without their parts along the known ones.
        away = np.vstack([-g[:k, k:], np.eye(len(names))])
        inner = away.T @ g @ away
        scale = 1.0 / np.sqrt(np.maximum(np.diag(inner), 1e-300))
        values, turned = np.linalg.eigh(inner * scale[:, None] * scale[None, :])
        if values[0] < 1e-13:
            raise RuntimeError("trial vectors are not independent; ask for fewer")
        table = combined(table, [*known, *names], away * scale @ turned / np.sqrt(values), names, *keep, *known)
        table = cut_lineage(table)
        if values[0] > 1e-4:
            return table
    return table


def three_terms(both: DataFrame, key: str, names: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """The next filter polynomial from the last two (``names``, ``p_``) and the operator's image of the last (``m_``)."""
    then = [(F.col("scale") * F.col(f"m_{c}") - 2 * F.col(c) - F.col(f"p_{c}")).alias(c) for c in names]
    return both.select(key, *kept, "scale", *then, *[F.col(c).alias(f"p_{c}") for c in names])


def leading(
    apply: Callable[[DataFrame, Sequence[str]], DataFrame],
    start: DataFrame,
    key: str,
    names: Sequence[str],
    k: int,
    tolerance: float,
    known: Sequence[str] = (),
    carried: Sequence[str] = (),
    advance: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None,
    several: Callable[[DataFrame, Sequence[str], int, float], DataFrame] | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """(table of key and the first k columns, values): the k largest eigenvalues of a positive operator, largest first, and its unit eigenvectors.

    ``apply(table, names)`` gives (key, names) after the operator, a row for each row of the table. start: key, independent trial columns, more of
    them than k, and the orthonormal eigenvectors ``known``, which are left out. carried: further columns that ``apply`` and ``advance`` need. advance: image and ``three_terms`` in one step that reads its table once. several(state, names, steps, scale): so many
    such steps at once, from key, names and ``p_`` columns to key, kept columns and names. The sign of a vector makes its largest component positive. tolerance:
    of |operator x - value x|, relative to the largest value. Raises RuntimeError if it isn't met.
    """
    names, w, kept = list(names), len(names), [*known, *carried]
    table = orthonormal(start, names, key, *carried, known=known)
    for r in range(MAX_ROUNDS):
        image = apply(table, names).select(key, *[F.col(c).alias(f"m_{c}") for c in names])
        both = cut_lineage(table.join(image, key))
        g = gram(both, [*names, *(f"m_{c}" for c in names)])[:w, w:]
        values, turn = np.linalg.eigh((g + g.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = [f"r_{c}" for c in names[:k]]
        off = combined(both, [*names, *(f"m_{c}" for c in names)], np.vstack([-turn[:, :k] * values[:k], turn[:, :k]]), ritz)
        squares = off.agg(*[F.sum(F.col(c) * F.col(c)).alias(c) for c in ritz]).first()
        if np.sqrt(max(squares)) <= tolerance * max(values[0], 1e-300):
            found = cut_lineage(combined(table, names, turn[:, :k], names[:k], key))
            peak = found.agg(*[F.max_by(F.col(c), F.struct(F.abs(F.col(c)), F.col(key))).alias(c) for c in names[:k]]).first()
            return found.select(key, *[(F.col(c) * (1.0 if peak[c] >= 0 else -1.0)).alias(c) for c in names[:k]]), values[:k]
        # Filter: between 0 and the least trial value the polynomial stays within 1, above it grows with its degree.
        middle = max(values[-1], 1e-12 * max(values[0], 1e-300)) / 2
        degree = min(DEGREE, max(2, int(np.log(2 * GROWTH) / np.arccosh(max(values[0] / middle - 1.0, 1.0 + 1e-9)))))
        if several is not None:
            state = both.select(key, *[((F.col(f"m_{c}") - middle * F.col(c)) / middle).alias(c) for c in names], *[F.col(c).alias(f"p_{c}") for c in names])
            state = cut_lineage(several(state, names, degree - 1, 2.0 / middle))
            table = orthonormal(state, names, key, *carried, known=known)
            continue
        # The scale is a column, so that all rounds run the same code.
        before = table.select(key, *kept, F.lit(2.0 / middle).alias("scale"), *[F.col(c).alias(f"p_{c}") for c in names])
        now = both.select(key, *[((F.col(f"m_{c}") - middle * F.col(c)) / middle).alias(c) for c in names])
        state = cut_lineage(now.join(before, key))
        for step in range(2, degree + 1):
            if advance is not None:
                state = advance(state, names)
                state = cut_lineage(state) if step % 2 == 0 else state
            else:
                image = apply(state.select(key, *names), names).select(key, *[F.col(c).alias(f"m_{c}") for c in names])
                state = cut_lineage(three_terms(state.join(image, key), key, names, kept))
        table = orthonormal(state, names, key, *carried, known=known)
    raise RuntimeError(f"eigenvectors did not settle in {MAX_ROUNDS} rounds")
