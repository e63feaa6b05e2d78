"""Vectors against a codebook: nearest codes, lookups, use and error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlattice.functions.vectors import l2_normalize, total
from seqlattice.operators.merging import row_position

#: Numbers that a codebook may have to be sent to all executors (64 MB).
MOST_NUMBERS = 8_000_000
WINDOW = 65_536


def normalized(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(vector, l2_normalize(F.col(vector)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of (code, vec) as one row: the bytes of both, and the length of a vector."""
    for b in batches:
        if b.num_rows:
            flat, size = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(b.column("vec").offsets.to_numpy())
            if b.column("vec").null_count or b.column("code").null_count or (size != size[0]).any():
                raise ValueError("a code or its vector is null, or the vectors differ in length")
            yield pa.RecordBatch.from_pydict({"codes": [b.column("code").to_numpy().tobytes()], "vecs": [flat.tobytes()], "d": pa.array([size[0]], pa.int32())})


def _code_blocks(codebook: DataFrame, code: str, code_vector: str, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, vectors) in blocks of at most ``most`` numbers (one code at least); of equal vectors the lowest code, as no other one can be nearest."""
    lowest = codebook.groupBy(F.col(code_vector).alias("vec")).agg(F.min(code).cast("long").alias("code")).select("code", "vec")
    held, n = [], 0
    for r in lowest.mapInArrow(_packed, "codes binary, vecs binary, d int").toLocalIterator():
        codes = np.frombuffer(r["codes"], np.int64)
        rows, step = np.frombuffer(r["vecs"], np.float64).reshape(len(codes), r["d"]), max(most // max(r["d"], 1), 1)
        while len(codes):
            held.append((codes[: step - n], rows[: step - n]))
            n += len(held[-1][0])
            codes, rows = codes[len(held[-1][0]) :], rows[len(held[-1][0]) :]
            if n == step:
                whole, held, n = tuple(map(np.concatenate, zip(*held))), [], 0
                yield whole
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


#: Distances that are held at once (4 MB).
AT_ONCE = 500_000


class Cells:
    """A block of a codebook in cells of as many codes each: by the triangle inequality a cell holds nothing nearer than the distance to its centre less
    its radius. Cells are halved at the median of their widest dimension, so building them takes no table of distances."""

    def __init__(self, codes: np.ndarray, table: np.ndarray, cells: int) -> None:
        whole, leaves = [(np.arange(len(table)), max(cells, 1))], []
        while whole:
            rows, k = whole.pop()
            if k == 1 or len(rows) < 2:
                leaves.append(rows)
                continue
            part = table[rows]
            values, at = part[:, part.var(axis=0).argmax()], max(len(rows) * (k // 2) // k, 1)
            order = np.argpartition(values, at)
            whole += [(rows[order[:at]], k // 2), (rows[order[at:]], k - k // 2)]
        order = np.concatenate(leaves)
        self.codes, self.table, self.ends = codes[order], table[order], np.cumsum([len(r) for r in leaves])
        parts = [self.table[e - len(r) : e] for r, e in zip(leaves, self.ends)]
        self.centres = np.array([p.mean(axis=0) for p in parts])
        self.low, self.high = np.array([p.min(axis=0) for p in parts]), np.array([p.max(axis=0) for p in parts])
        self.radius = np.array([np.sqrt(((p - m) ** 2).sum(axis=1).max()) for p, m in zip(parts, self.centres)])

    def nearest(self, x: np.ndarray, gap: np.ndarray, code: np.ndarray, seen: np.ndarray) -> None:
        """Lowers ``gap`` and ``code`` of the rows of ``x``; ``seen`` counts the codes that each was compared with."""
        step = max(AT_ONCE // len(self.centres), 1)
        chunks = [slice(i, i + step) for i in range(0, len(x), step)]
        own = np.concatenate([np.zeros(0, np.int64), *[_far(x[c], self.centres).argmin(axis=1) for c in chunks]])
        self._visit(x, np.arange(len(x)), own, gap, code, seen)
        pairs, wide = [], max(AT_ONCE // max(x.shape[1], 1), 1)
        for c in chunks:
            to = np.sqrt(np.maximum(_far(x[c], self.centres), 0))
            slack = 1e-6 * (1 + to.max(initial=0) + np.abs(x[c]).max(initial=0) * x.shape[1])  # more than the rounding of the distances
            near = to - self.radius <= (np.sqrt(gap[c]) + slack)[:, None]
            near[np.arange(len(to)), own[c]] = False
            rows, cells = np.nonzero(near)
            rows += c.start
            # of the cells left, those whose box is no farther than the nearest code so far
            out = [(self._outside(x, rows[i : i + wide], cells[i : i + wide]) <= np.sqrt(gap[rows[i : i + wide]]) + slack) for i in range(0, len(rows), wide)]
            kept = np.concatenate([np.zeros(0, bool), *out])
            pairs.append((rows[kept], cells[kept]))
            if c is chunks[-1] or sum(len(r) for r, _ in pairs) > AT_ONCE:
                self._visit(x, *map(np.concatenate, zip(*pairs)), gap, code, seen)
                pairs = []

    def _outside(self, x: np.ndarray, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The distance from each row to the box of its cell."""
        part = x[rows]
        return np.sqrt((np.maximum(np.maximum(self.low[cells] - part, part - self.high[cells]), 0) ** 2).sum(axis=1))

    def _visit(self, x: np.ndarray, rows: np.ndarray, cells: np.ndarray, gap: np.ndarray, code: np.ndarray, seen: np.ndarray) -> None:
        """Compares each of ``rows`` with the codes of its cell."""
        order = np.argsort(cells, kind="stable")
        rows, cells = rows[order], cells[order]
        for some in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(cells)) + 1):
            if len(some):
                k = cells[some[0]]
                of = slice(self.ends[k - 1] if k else 0, self.ends[k])
                _lower(x, self.codes[of], self.table[of], rows[some], gap, code)
                seen[rows[some]] += of.stop - of.start


def _far(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", table, table) - 2 * x @ table.T


def _lower(x: np.ndarray, codes: np.ndarray, table: np.ndarray, rows: np.ndarray, gap: np.ndarray, code: np.ndarray) -> None:
    """Compares ``rows`` with the codes of a table. The product tells the few that may be nearest; these are measured again without cancellation, so
    that ties go to the lowest code."""
    step = max(AT_ONCE // len(table), 1)
    if len(rows) > step:
        for i in range(0, len(rows), step):
            _lower(x, codes, table, rows[i : i + step], gap, code)
        return
    part, norms = x[rows], np.einsum("ij,ij->i", table, table)
    own = np.einsum("ij,ij->i", part, part)
    far = part @ table.T
    far *= -2
    far += norms  # less the row's own square
    least, slack = far.min(axis=1), 1e-9 * (own + norms.max())
    may = np.flatnonzero(least + own - slack <= gap[rows])
    if not len(may):
        return
    at, of = np.divmod(np.flatnonzero(far[may] <= (least + slack)[may, None]), len(table))
    at = may[at]
    exact = ((x[rows[at]] - table[of]) ** 2).sum(axis=1)
    order = np.lexsort((codes[of], exact, at))
    at, of, exact = at[order], of[order], exact[order]
    first = np.r_[True, np.diff(at) > 0]
    to, near, named = rows[at[first]], exact[first], codes[of[first]]
    better = (near < gap[to]) | (near == gap[to]) & (named < code[to])
    gap[to[better]], code[to[better]] = near[better], named[better]


#: Codes from which on a block is searched by cells.
CELLS_FROM = 1024


def nearest_code(vectors: DataFrame, codebook: DataFrame, unit: bool = True, vector: str = "vector", code: str = "code", code_vector: str = "vec", most: int = MOST_NUMBERS, cells_from: int = CELLS_FROM, compared: bool = False) -> DataFrame:
    """``vectors`` with the nearest code by squared distance (the lowest on ties) and that distance; null without codes.

    The codebook goes to every executor in blocks of at most ``most`` numbers. A block of ``cells_from`` codes or more is dealt to cells, and a
    vector is compared with its nearest cell's codes and with those of cells that the triangle inequality doesn't rule out, others with all codes;
    either way the result is exact. Every row carries the nearest code of the blocks so far, so nothing is shuffled. With ``compared`` a column of this
    name counts the codes that a row was compared with.
    """
    from pyspark.sql import types as T

    out = T.StructType([*vectors.schema.fields, T.StructField("code", T.LongType()), T.StructField("distance", T.DoubleType()), T.StructField("compared", T.LongType())])
    found = vectors.select("*", F.lit(None).cast("long").alias("code"), F.lit(None).cast("double").alias("distance"), F.lit(0).cast("long").alias("compared"))
    for codes, table in _code_blocks(normalized(codebook, code_vector) if unit else codebook, code, code_vector, most):
        shared = vectors.sparkSession.sparkContext.broadcast(Cells(codes, table, int(len(codes) ** 0.5) if len(codes) >= cells_from else 1))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            cells = shared.value
            for b in batches:
                x = np.stack(b[vector].to_numpy()).astype(np.float64) if len(b) else np.zeros((0, cells.table.shape[1]))
                if unit:
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                gap, seen = b["distance"].to_numpy(np.float64, na_value=np.inf).copy(), b["compared"].to_numpy(np.int64).copy()
                best = b["code"].astype("Int64").to_numpy(np.int64, na_value=np.iinfo(np.int64).max).copy()
                cells.nearest(x, gap, best, seen)
                yield b.assign(code=best, distance=gap, compared=seen)

        found = found.mapInPandas(run, out)
    return found if compared else found.drop("compared")


def _books(codebook: DataFrame, unit: bool, code: str, code_vector: str, most: int) -> list[DataFrame]:
    """The codebook as tables of one row, ``_book``: an array of (code, vector) in ascending order, of at most ``most`` numbers."""
    c = (normalized(codebook, code_vector) if unit else codebook).select(F.col(code).cast("long").alias("code"), F.col(code_vector).alias("vec"))
    head = c.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).head()
    blocks = -(-(head["n"] or 0) * (head["d"] or 0) // most)
    if blocks > 1:
        c = row_position(c, ["code"], "_place").withColumn("_block", F.floor(F.col("_place") * blocks / head["n"]))
    one = lambda part: part.agg(F.array_sort(F.collect_list(F.struct("code", "vec"))).alias("_book"))
    return [one(c.where(F.col("_block") == i) if blocks > 1 else c) for i in range(blocks)]


def _gap(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))))


def nearest_code_exact(vectors: DataFrame, codebook: DataFrame, unit: bool = True, vector: str = "vector", code: str = "code", code_vector: str = "vec", most: int = MOST_NUMBERS) -> DataFrame:
    """The same by built-in operations: every row meets the codebook as an array, block after block, and keeps the least
    (distance, code)."""
    best = vectors.withColumn("_x", l2_normalize(F.col(vector)) if unit else F.col(vector)).withColumn("_best", F.lit(None).cast("struct<distance:double,code:long>"))
    for book in _books(codebook, unit, code, code_vector, most):
        # a table of one row
        met = best.crossJoin(F.broadcast(book))
        least = F.array_min(F.transform("_book", lambda c: F.struct(_gap(F.col("_x"), c["vec"]).alias("distance"), c["code"].alias("code"))))
        best = met.withColumn("_best", F.least("_best", least)).drop("_book")
    return best.select(*vectors.columns, F.col("_best.code").alias("code"), F.col("_best.distance").alias("distance"))


def code_distances(vectors: DataFrame, codebook: DataFrame, unit: bool = True, vector: str = "vector", code: str = "code", code_vector: str = "vec", most: int = MOST_NUMBERS) -> DataFrame:
    """``vectors`` with ``distances``: the squared distance to every code, in ascending order of the codes."""
    out = vectors.withColumn("_x", l2_normalize(F.col(vector)) if unit else F.col(vector)).withColumn("distances", F.array().cast("array<double>"))
    for book in _books(codebook, unit, code, code_vector, most):
        out = out.crossJoin(F.broadcast(book)).withColumn("distances", F.concat("distances", F.transform("_book", lambda c: _gap(F.col("_x"), c["vec"])))).drop("_book")
    return out.drop("_x")


def code_lookup(codes: DataFrame, codebook: DataFrame, code: str = "code", code_vector: str = "vec") -> DataFrame:
    """``codes`` with the unit vector of each code."""
    return codes.join(normalized(codebook, code_vector).select(F.col(code), F.col(code_vector).alias("quantized")), code)


def codebook_usage(codes: DataFrame, n_codes: int, order: str, code: str = "code", window: int = WINDOW) -> DataFrame:
    """Share of the codebook among the latest ``window`` codes. Until the window is full its empty places count as code 0."""
    latest = codes.orderBy(F.col(order).desc()).limit(window)
    seen = latest.agg(F.count("*").alias("n"), F.count_distinct(code).alias("k"), F.coalesce(F.bool_or(F.col(code) == 0), F.lit(False)).alias("zero"))
    used = F.col("k") + F.when((F.col("n") < window) & ~F.col("zero"), 1).otherwise(0)
    return seen.select(used.cast("long").alias("used_codes"), (used / F.lit(n_codes)).alias("usage"))


def usage_slices(codes: DataFrame, slice_: Column, code: str = "code") -> DataFrame:
    """(slice, codes, sketch): what each slice of a long history has used, as a mergeable sketch; slices are kept, and any span's use is their union."""
    return codes.groupBy(slice_.alias("slice")).agg(F.count(code).alias("codes"), F.hll_sketch_agg(F.col(code).cast("long"), 14).alias("sketch"))


def sliced_usage(slices: DataFrame, n_codes: int, by: list[str] | None = None) -> DataFrame:
    """(used_codes, usage) of the union of slices: estimates, within 3 % (``codebook_usage`` counts exactly)."""
    used = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return slices.groupBy(*(by or [])).agg(used.alias("used_codes"), F.sum("codes").alias("codes")).withColumn("usage", F.col("used_codes") / F.lit(n_codes))


def quantization_error(assigned: DataFrame, codebook: DataFrame, beta: float = 0.25, by: list[str] | None = None, vector: str = "vector", code: str = "code", code_vector: str = "vec") -> DataFrame:
    """Mean squared error of unit vectors against their codes, the commitment loss, and the number of values; groups
    combine by their numbers (see ``combined_error``)."""
    both = code_lookup(normalized(assigned, vector), codebook, code, code_vector)
    sq = total(F.zip_with(F.col(vector), "quantized", lambda a, b: (a - b) * (a - b)))
    s = both.select(*(by or []), sq.alias("sq"), F.size(vector).alias("d")).groupBy(*(by or [])).agg(F.sum("sq").alias("sq"), F.sum("d").alias("n_values"))
    return s.select(*(by or []), (F.col("sq") / F.col("n_values")).alias("mse"), (F.lit(beta) * F.col("sq") / F.col("n_values")).alias("commitment"), "n_values")


def combined_error(parts: DataFrame) -> DataFrame:
    return parts.agg((F.sum(F.col("mse") * F.col("n_values")) / F.sum("n_values")).alias("mse"), F.sum("n_values").alias("n_values"))


def assignment_entropy(rows: DataFrame, distances: str = "distances", temperature: float = 0.01) -> DataFrame:
    """(sample_entropy, mean_entropy, loss): softmax of -distance / temperature over each row's distances to all codes; mean of the
    rows' entropies less the entropy of the mean distribution. 1e-5 keeps the latter's logarithm finite.

    The softmax stays in its row; the mean distribution is summed by code before it is shuffled.
    """
    z = rows.select(F.transform(distances, lambda d: -d / F.lit(temperature)).alias("z")).withColumn("top", F.array_max("z"))
    logs = lambda s: F.transform("z", lambda x: x - s)
    log_sum = F.col("top") + F.log(total(F.transform("z", lambda x: F.exp(x - F.col("top")))))
    p = z.select(F.element_at(F.transform(F.array(log_sum), logs), 1).alias("l")).select("l", F.transform("l", lambda x: F.exp(x)).alias("p"))
    sample = p.agg(F.avg(-total(F.zip_with("p", "l", lambda a, b: a * b))).alias("sample_entropy"), F.count("*").alias("n"))
    # the outer form: for the inner one the optimizer adds a filter on the array's size, and pushes all distances with it into a join
    means = p.select(F.posexplode_outer("p").alias("at", "p")).where("at is not null").groupBy("at").agg(F.sum("p").alias("s"))
    # one row
    mean = means.crossJoin(F.broadcast(sample)).agg((-F.sum(F.col("s") / F.col("n") * F.log(F.col("s") / F.col("n") + F.lit(1e-5)))).alias("mean_entropy"), F.first("sample_entropy").alias("sample_entropy"))
    return mean.select("sample_entropy", "mean_entropy", (F.col("sample_entropy") - F.col("mean_entropy")).alias("loss"))
