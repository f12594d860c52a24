"""Ridge lines where rows are fewer than components, and decoding rerun inside resamples.

A line has two forms with one solution: the normal equations, of the size of the components, and the kernel system, of
the size of the rows. `weighted_lines` takes the smaller. Over Spark the kernel form works on slices of the components:
a task holds all rows of one slice, and its share of each Gram matrix (rows by rows, standardised by the rows that are
fitted) is added up, slice by slice, in the task that solves the system of a held clause. What one task holds is rows
times the width of a slice, or rows squared; since this form is for rows fewer than components, both are bounded by
the components. The other form adds up one matrix of sums for each clause and fold, in parts of a bounded size, and
solves each held clause's systems in a task of its own. Nothing but penalties, accuracies, one coefficient a row and the
lines themselves goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import PENALTIES, Moments, matrix, numbers, summed

# The part of a Gram matrix that one row of the exchange holds, in bytes.
PART_BYTES = 4 << 20
# The least width of a slice of components.
LEAST_WIDTH = 256


def weighted_lines(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights [penalty, component] and intercepts on standardised columns, in terms of plain ones; w counts each row.

    The intercept is free. With fewer rows than components the kernel system is solved, else the normal equations; one
    decomposition serves all penalties either way.
    """
    used = w > 0
    x, y, w = x[used], y[used], w[used].astype(float)
    if len(x) >= x.shape[1]:
        wide = np.column_stack([np.ones(len(x)), x, y])
        return Moments((wide.T @ (w[:, None] * wide)).reshape(-1), x.shape[1]).lines(penalties)
    n = max(w.sum(), 1.0)
    mean, middle = w @ x / n, w @ y / n
    spread = np.sqrt(w @ (x - mean) ** 2 / n) + 1e-8
    z, root = (x - mean) / spread, np.sqrt(w)
    coefficients = kernel_solve((root[:, None] * z) @ (root[:, None] * z).T, root * (y - middle), penalties)
    weights = (coefficients * root) @ z / spread
    return weights, middle - weights @ mean


def kernel_solve(gram: np.ndarray, y: np.ndarray, penalties: np.ndarray) -> np.ndarray:
    """[penalty, row]: the coefficients of (gram + penalty) a = y."""
    values, axes = np.linalg.eigh(gram)
    return ((axes.T @ y) / (np.maximum(values, 0) + penalties[:, None])) @ axes.T


def first_best(accuracy: np.ndarray) -> int:
    """The place of the least penalty among the best, from [fold, penalty] with nan for folds that cannot judge."""
    judged = accuracy[~np.isnan(accuracy).all(axis=1)]
    mean = judged.mean(axis=0) if len(judged) else np.zeros(accuracy.shape[1])
    return int(np.flatnonzero(mean >= mean.max() - 1e-12)[0])


def _sliced(units: DataFrame, width: int, slices: int) -> DataFrame:
    """One row a slice of the components: all members (pair, y, clause, fold, part)."""
    member = lambda c, y: F.struct(F.lit(y).alias("y"), F.col(c).alias("x"))
    rows = units.select("pair", "clause", "fold", F.explode(F.array(member("c", 1.0), member("b", -1.0))).alias("m"))
    part = lambda s: F.struct(s.alias("s"), F.transform(F.slice("m.x", s * width + 1, F.lit(width)), lambda v: v.cast("double")).alias("part"))
    cut = rows.select("pair", "clause", "fold", F.col("m.y").alias("y"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), part)).alias("p"))
    return cut.groupBy("p.s").agg(F.collect_list(F.struct("pair", "y", "clause", "fold", F.col("p.part").alias("part"))).alias("rows"))


def _unpacked(batch: pa.RecordBatch, r: int, clauses: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y, place of the clause, and fold of the members in one slice, always in the same order."""
    rows = batch.column(1)[r].values
    pair, y = (rows.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    order = np.lexsort((y, pair))
    place = {c: i for i, c in enumerate(clauses)}
    own = np.array([place[c] for c in rows.field(2).to_pylist()])
    x = rows.field(4).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    return x[order], y[order], own[order], rows.field(3).to_numpy(zero_copy_only=False).astype(int)[order]


def _fitted_rows(own: np.ndarray, fold: np.ndarray, g: int, f: int, folds: int) -> np.ndarray:
    return (own != g) & ((fold != f) | (f == folds))


def _standard(x: np.ndarray, fitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spread = (x[fitted].std(axis=0) if fitted.any() else np.zeros(x.shape[1])) + 1e-8
    return (x - (x[fitted].mean(axis=0) if fitted.any() else 0.0)) / spread, spread


def kernel_leave_one_out(units: DataFrame, clauses: list, dims: int, folds: int = 5) -> tuple[dict, dict]:
    """What models.leave_one_out gives, by the kernel form: per clause the penalty chosen on the others, and its line.

    units: pair, clause, fold, b, c. For each held clause there is one Gram matrix a fold and one for the fit on all.
    """
    spark, k = units.sparkSession, len(clauses)
    n = 2 * units.count()
    width = max(n, LEAST_WIDTH, -(-dims // spark.sparkContext.defaultParallelism))
    sliced = _sliced(units, width, -(-dims // width))
    lines_of_part = max(1, PART_BYTES // (8 * max(n, 1)))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                x, y, own, fold = _unpacked(batch, r, clauses)
                for g in range(k):
                    for f in range(folds + 1):
                        z, _ = _standard(x, _fitted_rows(own, fold, g, f, folds))
                        for at in range(0, n, lines_of_part):
                            part = z[at : at + lines_of_part] @ z.T
                            about = [y.tolist(), own.tolist(), fold.tolist()] if at == 0 else [[], [], []]
                            columns = [pa.array([v], t) for v, t in zip((g, f, at, part.tobytes(), *about), GRAM_TYPES, strict=True)]
                            yield pa.RecordBatch.from_arrays(columns, GRAM_NAMES)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, now, y, own, fold, accuracy = None, None, None, None, None, []

        def finish() -> Iterator[pa.RecordBatch]:
            g, f = now
            fitted = _fitted_rows(own, fold, g, f, folds)
            inner, middle = gram[np.ix_(fitted, fitted)], y[fitted].mean() if fitted.any() else 0.0
            if f < folds:
                judge = (own != g) & (fold == f)
                scores = gram[np.ix_(judge, fitted)] @ kernel_solve(inner, y[fitted] - middle, PENALTIES).T + middle
                right = (np.sign(scores) == y[judge][:, None]).mean(axis=0) if judge.any() else np.full(len(PENALTIES), np.nan)
                accuracy.append(right)
                return
            best = first_best(np.array(accuracy))
            a = np.zeros(len(y))
            a[fitted] = kernel_solve(inner, y[fitted] - middle, PENALTIES[best : best + 1])[0]
            accuracy.clear()
            yield pa.RecordBatch.from_pylist([{"g": g, "best": best, "a": a.tolist()}], pa.schema([("g", pa.int32()), ("best", pa.int32()), ("a", pa.list_(pa.float64()))]))

        for batch in batches:
            for r in range(len(batch)):
                g, f, at = (batch.column(i)[r].as_py() for i in range(3))
                if now != (g, f):
                    if now is not None:
                        yield from finish()
                    now, gram = (g, f), np.zeros((n, n))
                if at == 0:
                    y, own, fold = (batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i in (4, 5, 6))
                part = np.frombuffer(batch.column(3)[r].as_buffer(), float).reshape(-1, n)
                gram[at : at + len(part)] += part
        if now is not None:
            yield from finish()

    parts = sliced.mapInArrow(grams, "g int, f int, at int, part binary, y array<double>, own array<int>, fold array<int>")
    one_clause = parts.repartition(k, "g").sortWithinPartitions("g", "f", "at")
    found = {r["g"]: r for r in one_clause.mapInArrow(solved, "g int, best int, a array<double>").collect()}  # a number for each clause and row
    a = np.array([found[g]["a"] for g in range(k)]).reshape(k, n)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                x, y, own, fold = _unpacked(batch, r, clauses)
                out = []
                for g in range(k):
                    fitted = _fitted_rows(own, fold, g, folds, folds)
                    z, spread = _standard(x, fitted)
                    w = a[g] @ z / spread
                    mean = x[fitted].mean(axis=0) if fitted.any() else np.zeros(x.shape[1])
                    out.append({"g": g, "s": batch.column(0)[r].as_py(), "w": w.tolist(), "shift": float(w @ mean), "middle": float(y[fitted].mean()) if fitted.any() else 0.0})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("g", pa.int32()), ("s", pa.int32()), ("w", pa.list_(pa.float64())), ("shift", pa.float64()), ("middle", pa.float64())]))

    pieces = sliced.mapInArrow(weights, "g int, s int, w array<double>, shift double, middle double").orderBy("s").collect()  # the lines: clauses x dims
    lines = {}
    for g, clause in enumerate(clauses):
        mine = [p for p in pieces if p["g"] == g]
        lines[clause] = (np.concatenate([p["w"] for p in mine])[:dims], mine[0]["middle"] - sum(p["shift"] for p in mine))
    return {c: float(PENALTIES[found[g]["best"]]) for g, c in enumerate(clauses)}, lines


PART_NAMES, PART_TYPES = ["cell", "at", "part"], [pa.int32(), pa.int32(), pa.binary()]


def _part(cell: int, at: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((cell, at, values.tobytes()), PART_TYPES, strict=True)], PART_NAMES)


def moment_lines(units: DataFrame, clauses: list, dims: int, folds: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each held clause g and fold f the lines of all penalties from the rows outside both; f = folds leaves none out.

    units: clause, fold, b, c. Sums of each clause and fold are made in one pass, travel as parts of a matrix, are added
    up by part, and are combined and solved clause by clause in tasks.
    """
    k, width = len(clauses), Moments.width(dims)
    place, each = {c: i for i, c in enumerate(clauses)}, PART_BYTES // 8

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            own = np.array([place[c] for c in batch.column(0).to_pylist()], int)
            key, b, c = own * folds + numbers(batch, "fold").astype(int), matrix(batch, "b"), matrix(batch, "c")
            for cell in np.unique(key):
                at = key == cell
                sums = Moments.of(np.concatenate([c[at], b[at]]), np.repeat([1.0, -1.0], at.sum()))
                total[int(cell)] = total[int(cell)] + sums if int(cell) in total else sums
        for cell, sums in total.items():
            for at in range(0, width, each):
                yield _part(cell, at, sums[at : at + each])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for r in range(len(batch)):
                key, values = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py()), np.frombuffer(batch.column(2)[r].as_buffer(), float)
                if key != now and now is not None:
                    yield _part(*now, total)
                now, total = key, values if key != now else total + values
        if now is not None:
            yield _part(*now, total)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest = None, None

        def finish() -> Iterator[pa.RecordBatch]:
            every = rest.sum(axis=0)
            for f in range(folds + 1):
                w, free = Moments(every - rest[f] if f < folds else every, dims).lines(PENALTIES)
                yield pa.RecordBatch.from_pylist([{"g": now, "f": f, "w": w.reshape(-1).tolist(), "free": free.tolist()}], pa.schema([("g", pa.int32()), ("f", pa.int32()), ("w", pa.list_(pa.float64())), ("free", pa.list_(pa.float64()))]))

        for batch in batches:
            for r in range(len(batch)):
                g, cell, at = (batch.column(i)[r].as_py() for i in range(3))
                if g != now:
                    if now is not None:
                        yield from finish()
                    now, rest = g, np.zeros((folds, width))
                part = np.frombuffer(batch.column(3)[r].as_buffer(), float)
                rest[cell % folds, at : at + len(part)] += part
        if now is not None:
            yield from finish()

    ddl = "cell int, at int, part binary"
    parts = units.select("clause", "fold", "b", "c").mapInArrow(cells, ddl)
    sums = parts.repartition("cell", "at").sortWithinPartitions("cell", "at").mapInArrow(added, ddl)
    held = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda g: g != F.expr(f"cell div {folds}"))
    dealt = sums.select(F.explode(held).alias("g"), "cell", "at", "part").repartition(k, "g").sortWithinPartitions("g")
    found = dealt.mapInArrow(solved, "g int, f int, w array<double>, free array<double>").collect()  # lines alone
    return {(r["g"], r["f"]): (np.array(r["w"]).reshape(len(PENALTIES), dims), np.array(r["free"])) for r in found}


def leave_one_out(units: DataFrame, clauses: list, dims: int, folds: int = 5) -> tuple[dict, dict]:
    """Nested decoding over all rows: for each clause the penalty chosen on the others, and its line (weights, intercept).

    units: pair, clause, fold, b, c (vectors of dims). The penalty of least size wins ties. The kernel form is used when
    rows are fewer than components; both forms have the same solution.
    """
    if 2 * units.count() < dims:
        return kernel_leave_one_out(units, clauses, dims, folds)
    place, k, p = {c: i for i, c in enumerate(clauses)}, len(clauses), len(PENALTIES)
    fitted = moment_lines(units, clauses, dims, folds)
    none = (np.zeros((p, dims)), np.zeros(p))
    weights = np.array([[fitted.get((g, f), none)[0] for f in range(folds)] for g in range(k)])
    free = np.array([[fitted.get((g, f), none)[1] for f in range(folds)] for g in range(k)])

    def signs(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        own, fold = np.array([place[c] for c in batch.column(0).to_pylist()], int), numbers(batch, "fold").astype(int)
        b, c, out = matrix(batch, "b"), matrix(batch, "c"), {}
        for f in np.unique(fold):
            at = fold == f
            right = np.zeros((at.sum(), k, p))
            for x, sign in ((c[at], 1), (b[at], -1)):
                right += np.sign(np.einsum("nd,gpd->ngp", x, weights[:, f], optimize=True) + free[:, f]) == sign
            right[np.arange(at.sum()), own[at]] = 0  # a held clause's own rows choose nothing
            judged = np.full((at.sum(), k), 2.0)
            judged[np.arange(at.sum()), own[at]] = 0
            out[int(f)] = np.append(right.sum(axis=0).reshape(-1), judged.sum(axis=0))
        return out

    hits = np.full((folds, k, p), np.nan)
    for f, values in summed(units, ["clause", "fold", "b", "c"], signs, k * p + k).items():
        right, judged = values[: k * p].reshape(k, p), values[k * p :]
        hits[f] = np.where(judged[:, None] > 0, right / np.maximum(judged, 1)[:, None], np.nan)
    best = [first_best(hits[:, g]) for g in range(k)]
    lines = {c: (fitted.get((g, folds), none)[0][best[g]], float(fitted.get((g, folds), none)[1][best[g]])) for c, g in place.items()}
    return {c: float(PENALTIES[best[g]]) for c, g in place.items()}, lines


GRAM_NAMES = ["g", "f", "at", "part", "y", "own", "fold"]
GRAM_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32())]


def decoded_macro(b: np.ndarray, c: np.ndarray, clause: np.ndarray, fold: np.ndarray, w: np.ndarray, folds: int) -> float:
    """Leave-one-clause-out decoding of weighted pairs: per held clause the penalty is chosen by folds of the others.

    Gives the mean over clauses of the weighted accuracy of their pairs. With as many rows as components the sums of each
    clause and fold are made once and combined; with fewer, every fit is a kernel system.
    """
    x, y = np.concatenate([c, b]), np.repeat([1.0, -1.0], len(c))
    own, part, weight = np.tile(clause, 2), np.tile(fold, 2), np.tile(w, 2).astype(float)
    groups, dims = np.unique(clause[w > 0]), x.shape[1]
    sums = None
    if (weight > 0).sum() >= dims:
        wide = np.column_stack([np.ones(len(x)), x, y])
        sums = {(g, f): (wide[at].T @ (weight[at, None] * wide[at])) for g in groups for f in range(folds) for at in [(own == g) & (part == f)]}
        by_fold = [sum(sums[g, f] for g in groups) for f in range(folds)]
        by_group = {g: sum(sums[g, f] for f in range(folds)) for g in groups}
        total = sum(by_fold)

    def fitted(g: int, f: int | None, penalties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if sums is None:
            keep = (own != g) & ((part != f) if f is not None else True)
            return weighted_lines(x, y, np.where(keep, weight, 0.0), penalties)
        values = total - by_group[g] if f is None else total - by_group[g] - by_fold[f] + sums[g, f]
        return Moments(values.reshape(-1), dims).lines(penalties)

    accuracies = []
    for g in groups:
        judged = []
        for f in range(folds):
            at = (own != g) & (part == f) & (weight > 0)
            if at.any() and ((own != g) & (part != f) & (weight > 0)).any():
                lines, free = fitted(g, f, PENALTIES)
                judged.append(weight[at] @ (np.sign(x[at] @ lines.T + free) == y[at][:, None]) / weight[at].sum())
        best = first_best(np.array(judged)) if judged else 0
        (line,), _ = fitted(g, None, PENALTIES[best : best + 1])
        mine = (clause == g) & (w > 0)
        margin = c[mine] @ line - b[mine] @ line
        accuracies.append(w[mine] @ np.where(margin > 0, 1.0, np.where(margin == 0, 0.5, 0.0)) / w[mine].sum())
    return float(np.mean(accuracies))


def resample_weights(stratum: np.ndarray, span: np.ndarray, seed: int) -> np.ndarray:
    """How often each pair is drawn: within every stratum as many spans as it has, with replacement, whole spans."""
    rng, out = np.random.default_rng(seed), np.zeros(len(span))
    for s in np.unique(stratum):
        spans = np.unique(span[stratum == s])
        times = np.bincount(rng.integers(0, len(spans), len(spans)), minlength=len(spans))
        mine = stratum == s
        out[mine] = times[np.searchsorted(spans, span[mine])]
    return out


def shuffled_folds(span: np.ndarray, w: np.ndarray, folds: int, seed: int) -> np.ndarray:
    """Folds of the drawn spans: sorted, shuffled, dealt in turn."""
    spans = np.unique(span[w > 0])
    order = np.random.default_rng(seed).permutation(len(spans))
    dealt = np.empty(len(spans), int)
    dealt[order] = np.arange(len(spans)) % folds
    return dealt[np.minimum(np.searchsorted(spans, span), len(spans) - 1)]


# Bytes of one study that a task may hold, as doubles.
STUDY_BYTES = 1 << 30
# Bytes of the lines that a task holds for its draws, where the study streams by.
LINES_BYTES = 128 << 20
# Pairs of a cell that one row of the stream holds.
CELL_PAIRS = 4096
CELL_DDL = "kind int, clause string, stratum string, span string, part binary"
CELL_NAMES, CELL_TYPES = ["kind", "clause", "stratum", "span", "part"], [pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary()]


def _cells(rows: DataFrame, dims: int, stored: str) -> DataFrame:
    """The study by cells of clause, stratum and span: the sums of a cell's members (kind 0), and its pairs (kind 1).

    Rows of a cell follow each other, so a task holds the pairs of one row of the stream and one matrix of sums.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, n, sums = None, [], 0, None

        def row(kind: int, values: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((kind, *now, values.tobytes()), CELL_TYPES, strict=True)], CELL_NAMES)

        def pairs() -> pa.RecordBatch:
            return row(1, np.concatenate([m for side in (0, 1) for m in [p[side] for p in kept]]).astype(stored))

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            b, c = matrix(batch, "b"), matrix(batch, "c")
            starts = [i for i, key in enumerate(keys) if i == 0 or key != keys[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[lo] != now:
                    if now is not None:
                        yield row(0, sums)
                        if n:
                            yield pairs()
                    now, kept, n, sums = keys[lo], [], 0, np.zeros(Moments.width(dims))
                for at in range(lo, hi, CELL_PAIRS):
                    some = slice(at, min(at + CELL_PAIRS, hi))
                    kept.append((b[some], c[some]))
                    n += some.stop - some.start
                    sums += Moments.of(np.concatenate([c[some], b[some]]), np.repeat([1.0, -1.0], some.stop - some.start))
                    if n >= CELL_PAIRS:
                        yield pairs()
                        kept, n = [], 0
        if now is not None:
            yield row(0, sums)
            if n:
                yield pairs()

    keys = ["clause", "stratum", "span"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(packed, CELL_DDL)


class Decodings:
    """The nested decodings of some draws over a study that streams by, from the sums of its cells.

    A draw weighs whole cells, so its fits are combinations of their sums, made once all sums are here; the pairs that
    follow are only judged, and what is kept of them is how often each line was right.
    """

    def __init__(self, draws: range, dims: int, folds: int, seed: int) -> None:
        self.draws, self.dims, self.folds, self.seed = draws, dims, folds, seed
        self.cells: dict[tuple[str, str, str], np.ndarray] = {}
        self.place: dict[tuple[str, str, str], int] = {}

    def add(self, cell: tuple[str, str, str], sums: np.ndarray) -> None:
        self.cells[cell] = self.cells[cell] + sums if cell in self.cells else sums

    def fit(self) -> None:
        """The draws' weights and folds of the cells, and the lines of every held clause and fold for all penalties."""
        keys = sorted(self.cells)
        self.place = {key: i for i, key in enumerate(keys)}
        self.clause, stratum, span = (np.unique([key[i] for key in keys], return_inverse=True)[1] for i in range(3))
        sums = np.array([self.cells.pop(key) for key in keys])
        k, p, many, members = self.clause.max() + 1, len(PENALTIES), len(self.draws), sums[:, 0]
        end = np.searchsorted(self.clause, np.arange(k + 1))
        self.weight, self.fold = np.zeros((many, len(keys))), np.zeros((many, len(keys)), int)
        self.lines, self.whole = np.zeros((many, self.folds, k * p, self.dims + 1)), np.zeros((many, k, p, self.dims))
        self.right, self.won = np.zeros((many, self.folds, k, p)), np.zeros((many, k, p))
        self.judged, self.drawn = np.zeros((many, self.folds, k)), np.zeros((many, k))
        for j, d in enumerate(self.draws):
            w = self.weight[j] = resample_weights(stratum, span, self.seed + 1 + d)
            fold = self.fold[j] = shuffled_folds(span, w, self.folds, self.seed + 1 + d)
            dealt = np.where(fold == np.arange(self.folds)[:, None], w, 0.0)
            by = np.array([dealt[:, lo:hi] @ sums[lo:hi] for lo, hi in zip(end, end[1:])])
            size = np.array([dealt[:, lo:hi] @ members[lo:hi] for lo, hi in zip(end, end[1:])])
            by_fold, by_group = by.sum(axis=0), by.sum(axis=1)
            total, self.drawn[j] = by_fold.sum(axis=0), size.sum(axis=1) / 2
            for g in range(k):
                self.whole[j, g] = Moments(total - by_group[g], self.dims).lines(PENALTIES)[0]
                others = size.sum(axis=0) - size[g]
                for f in range(self.folds):
                    if others[f] and others.sum() > others[f]:  # rows to judge, and rows to fit
                        self.judged[j, f, g] = others[f]
                        w, free = Moments(total - by_group[g] - by_fold[f] + by[g, f], self.dims).lines(PENALTIES)
                        self.lines[j, f, g * p : (g + 1) * p] = np.column_stack([w, free])

    def judge(self, cell: tuple[str, str, str], b: np.ndarray, c: np.ndarray) -> None:
        """Counts, draw by draw, the members that the others' lines tell right, and the pairs that the own clause's tell right."""
        if not self.place:
            self.fit()
        i, one = self.place[cell], np.ones((len(b), 1))
        g, k, p = self.clause[i], *self.whole.shape[1:3]
        x, diff = np.concatenate([np.hstack([c, one]), -np.hstack([b, one])]), c - b  # a member is told right where its signed score is positive
        for j in np.flatnonzero(self.weight[:, i]):
            f, w = self.fold[j, i], self.weight[j, i]
            right = np.count_nonzero(self.lines[j, f] @ x.T > 0, axis=1).reshape(k, p)
            right[g] = 0  # a held clause's own rows choose nothing
            self.right[j, f] += w * right
            margin = self.whole[j, g] @ diff.T
            self.won[j, g] += w * (np.count_nonzero(margin > 0, axis=1) + 0.5 * np.count_nonzero(margin == 0, axis=1))

    def macros(self) -> list[float]:
        """Per draw the mean over clauses of the accuracy of the chosen penalty's line."""
        found = []
        for j in range(len(self.draws)):
            accuracies = []
            for g in np.flatnonzero(self.drawn[j]):
                use = self.judged[j, :, g] > 0
                best = first_best(self.right[j, use, g] / self.judged[j, use, g][:, None]) if use.any() else 0
                accuracies.append(self.won[j, g, best] / self.drawn[j, g])
            found.append(float(np.mean(accuracies)))
        return found


def _streamed_resamples(rows: DataFrame, draws: int, folds: int, seed: int, clauses: int, dims: int, stored: str) -> DataFrame:
    """(draw, macro), the study streaming by the draws of each task: sums of the cells first, then their pairs."""
    lines = 8 * len(PENALTIES) * clauses * (folds * (dims + 1) + dims)
    parts = min(draws, max(8, rows.sparkSession.sparkContext.defaultParallelism, -(-draws * lines // LINES_BYTES)))
    sent = _cells(rows, dims, stored).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("task"), "*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Decodings] = {}
        for batch in batches:
            for r in range(len(batch)):
                task, kind, *cell = (batch.column(i)[r].as_py() for i in range(5))
                if task not in found:
                    found[task] = Decodings(range(task, draws, parts), dims, folds, seed)
                values = np.frombuffer(batch.column(5)[r].as_buffer(), stored if kind else float).astype(float)
                if kind:
                    found[task].judge(tuple(cell), *values.reshape(2, -1, dims))
                else:
                    found[task].add(tuple(cell), values)
        for some in found.values():
            yield pa.RecordBatch.from_arrays([pa.array(list(some.draws), pa.int64()), pa.array(some.macros(), pa.float64())], ["draw", "macro"])

    return sent.repartitionById(parts, "task").sortWithinPartitions("task", "kind").mapInArrow(run, "draw long, macro double")


def nested_resamples(units: DataFrame, draws: int, folds: int = 5, seed: int = 20260825) -> DataFrame:
    """(draw, macro): spans drawn within (clause, class), and the whole decoding, penalty choice included, run on each draw.

    units: pair, clause, cls, span, b, c. Draws are dealt over tasks; draw d has the seeds `seed + 1 + d`, whatever its
    task. Where a study has twice as many rows as components, and few enough cells of clause, class and span, their sums
    give the fits and the study streams by, whatever its size. Else each task gets the study, which must fit into one: a
    larger one than STUDY_BYTES stops with its size.
    """
    spark = units.sparkSession
    cell = F.struct("clause", "cls", "span")
    about = units.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("b")).alias("d"), F.count_distinct(cell).alias("cells"), F.count_distinct("clause").alias("clauses")).first()
    dims = about["d"] or 0
    named = [F.col("clause").cast("string").alias("clause"), F.concat_ws("|", "clause", "cls").alias("stratum"), F.col("span").cast("string").alias("span")]
    if about["n"] >= 2 * dims > 0 and 8 * about["cells"] * Moments.width(dims) <= STUDY_BYTES // 4:
        types = {units.schema[c].dataType.elementType.typeName() for c in ("b", "c")}
        return _streamed_resamples(units.select(*named, "b", "c"), draws, folds, seed, about["clauses"], dims, "f4" if types == {"float"} else "f8")
    size = 16 * about["n"] * dims
    if size > STUDY_BYTES:
        raise ValueError(f"a study of {size >> 20} MB is more than the {STUDY_BYTES >> 20} MB that a task may hold")
    parts = min(draws, max(8, spark.sparkContext.defaultParallelism * 2))
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    rows = units.select(F.struct("pair", *named, double("b").alias("b"), double("c").alias("c")).alias("u"))
    sent = rows.select("u", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).groupBy("part").agg(F.collect_list("u").alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                part, u = batch.column(0)[r].as_py(), batch.column(1)[r].values
                order = np.argsort(u.field(0).to_numpy(zero_copy_only=False))
                clause, stratum, span = (np.unique(np.array(u.field(i).to_pylist()), return_inverse=True)[1][order] for i in (1, 2, 3))
                b, c = (u.field(i).flatten().to_numpy(zero_copy_only=False).reshape(len(u), -1)[order] for i in (4, 5))
                mine = range(part, draws, parts)
                found = []
                for d in mine:
                    w = resample_weights(stratum, span, seed + 1 + d)
                    found.append(decoded_macro(b, c, clause, shuffled_folds(span, w, folds, seed + 1 + d), w, folds))
                yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.int64()), pa.array(found, pa.float64())], ["draw", "macro"])

    return sent.repartition(parts, "part").mapInArrow(run, "draw long, macro double")
