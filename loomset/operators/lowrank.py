"""Low-rank factors of weight deltas whose matrices are dealt over tasks by rows.

A matrix is blocks of rows; some consecutive blocks are a slot, and slots lie in buckets of a table, so that no pass shuffles the matrix. In each pass
the current directions (width x l numbers) go to the module's slots, and a slot answers with one packed row: the product d' d v, and the triangle of
d v. Products are summed as arrays in a tree, in which triangles meet by small QR factorisations (a tall-skinny QR), so both sides are made
orthonormal in every pass and small singular values aren't squared away. After the passes one more such tree gives the singular values. Directions
are written down after each pass: a lost executor repeats a pass at most.

A task holds a slot and a few arrays of width x l numbers, never a module. Directions that depend on earlier ones are zeroed, as noise would
otherwise be taken for directions where the rank asked for exceeds the delta's own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.storage import Scratch

#: Fixed value: a direction is dependent if less than this share of its length is left after projection.
DEPENDENT = 1e-6
#: Bytes of a slot, about; products that one task sums up; buckets at least.
SLOT, FAN, BUCKETS = 64 << 20, 16, 8

BLOCKS = "module string, slot int, ids array<bigint>, width int, delta binary"
BASIS = "module string, rank int, width int, basis array<double>, sigma array<double>, energy double, norm2 double"


def orthonormal(y: np.ndarray) -> np.ndarray:
    """Columns of y made orthonormal in their order by Gram-Schmidt, each projected twice; dependent ones become zero."""
    q = np.zeros_like(y)
    for j in range(y.shape[1]):
        c, length = y[:, j].copy(), np.linalg.norm(y[:, j])
        for _ in range(2):
            c -= q[:, :j] @ (q[:, :j].T @ c)
        left = np.linalg.norm(c)
        if left > DEPENDENT * max(length, 1e-30) and left > 1e-20:
            q[:, j] = c / left
    return q


def blocks_of(rows: DataFrame, block: int = 256, slot_bytes: int = SLOT) -> DataFrame:
    """rows (module, row, delta), a row of a matrix each -> BLOCKS."""

    def pack(keys: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("row")
        values = np.stack(part.column("delta").to_numpy()).astype("<f4") if len(part) else np.zeros((0, 0), "<f4")
        module, number = keys[0].as_py(), keys[1].as_py()
        slot = number // max(1, slot_bytes // max(1, block * 4 * values.shape[1]))
        return pa.table({"module": [module], "slot": pa.array([slot], pa.int32()), "ids": [part.column("row").to_pylist()], "width": pa.array([values.shape[1]], pa.int32()), "delta": [values.tobytes()]})

    return rows.select("module", F.floor(F.col("row") / block).alias("number"), "row", "delta").groupBy("module", "number").applyInArrow(pack, BLOCKS)


def _matrix(part: pa.Table, width: int) -> np.ndarray:
    """The slot's rows, in doubles."""
    held = [np.frombuffer(x.as_buffer(), "<f4").reshape(-1, width) for x in part.column("delta")]
    return np.concatenate(held).astype(np.float64)


def _held(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array, "<f8").tobytes()


def _read(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(width, -1) if width else np.zeros((0, 0))


PART = "module string, place int, z binary"


def _by_slot(blocks: DataFrame, v: DataFrame, product: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """PART: of each slot the product of its rows and the module's directions v (at, module, slot, width, v)."""

    def run(part: pa.Table, directions: pa.Table) -> pa.Table:
        if not len(part) or not len(directions):
            return pa.table({"module": pa.array([], pa.string()), "place": pa.array([], pa.int32()), "z": pa.array([], pa.binary())})
        width = directions.column("width")[0].as_py()
        z = product(_matrix(part, width), _read(directions.column("v")[0].as_py(), width))
        return pa.table({"module": [part.column("module")[0].as_py()], "place": pa.array([part.column("slot")[0].as_py()], pa.int32()), "z": [_held(z)]})

    return blocks.groupBy("at").cogroup(v.groupBy("at")).applyInArrow(run, PART)


def _tree(parts: DataFrame, slots: int, combine: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """PART with one row for each module: combined FAN at a time, level by level."""

    def run(keys: tuple, part: pa.Table) -> pa.Table:
        ordered = part.sort_by("place").column("z").to_pylist()
        return pa.table({"module": [keys[0].as_py()], "place": pa.array([keys[1].as_py()], pa.int32()), "z": [_held(combine(ordered))]})

    while True:
        parts = parts.withColumn("place", F.floor(F.col("place") / FAN).cast("int")).groupBy("module", "place").applyInArrow(run, PART)
        slots = -(-slots // FAN)
        if slots <= 1:
            return parts


def _triangle(y: np.ndarray) -> np.ndarray:
    """R of y's QR factorisation, as square as y is wide; rows that a low y lacks are zeros."""
    r = np.zeros((y.shape[1], y.shape[1]))
    got = np.linalg.qr(y, mode="r")
    r[: len(got)] = got
    return r


def _both_sides(d: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Packed: the number l of directions, the triangle of d v (l x l), and d' d v."""
    y = d @ v
    return np.concatenate([[v.shape[1]], _triangle(y).ravel(), (d.T @ y).ravel()])


def _unpacked(z: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(z, "<f8")
    n = int(flat[0])
    return flat[1 : 1 + n * n].reshape(n, n), flat[1 + n * n :].reshape(-1, n)


def _merged(parts: list[bytes]) -> np.ndarray:
    """Triangles by QR of what is stacked, products by their sum."""
    r, z = zip(*map(_unpacked, parts), strict=True)
    return np.concatenate([[r[0].shape[1]], _triangle(np.concatenate(r)).ravel(), np.sum(z, axis=0).ravel()])


def _next(z: bytes) -> np.ndarray:
    """The next directions: d' q made orthonormal, where q is d v made orthonormal. q isn't formed: it is d v times the inverse of its triangle."""
    r, z = _unpacked(z)
    q = orthonormal(r)
    kept = np.flatnonzero(q.any(axis=0))
    out = np.zeros_like(z)
    if len(kept):
        out[:, kept] = np.linalg.solve((q[:, kept].T @ r[:, kept]).T, z[:, kept].T).T
    return orthonormal(out)


def low_rank_basis(rows: DataFrame, rank: int = 32, oversample: int = 8, niter: int = 2, seed: int = 0, block: int = 256, slot_bytes: int = SLOT) -> DataFrame:
    """factors of rows (module, row, delta), a row of a matrix each, of one width in a module: BASIS."""
    return factored(blocks_of(rows, block, slot_bytes), rank, oversample, niter, seed)[0]


def factored(blocks: DataFrame, rank: int = 32, oversample: int = 8, niter: int = 2, seed: int = 0, finish: Callable[[DataFrame, DataFrame], DataFrame] | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame | None]:
    """BLOCKS -> BASIS: the leading right singular vectors (width x rank), their singular values, and the share of squared size that they hold (1 for zeros).

    finish(blocks, basis by slot) may make more of the bucketed blocks; its rows are written down too. Of equal singular values another run may give
    other vectors, so the basis is a table that stays. buckets: tasks of a pass; choose about as many as there are slots.
    """
    spark = blocks.sparkSession
    extra = rank + oversample
    with Scratch(spark) as run:
        held = run.bucketed(blocks.withColumn("at", F.concat_ws(":", F.col("slot").cast("string"), "module")), "blocks", "at", buckets)

        def norms(part: pa.RecordBatch) -> pa.RecordBatch:
            n2 = [float((np.frombuffer(x.as_buffer(), "<f4").astype(np.float64) ** 2).sum()) for x in part.column("delta")]
            return pa.RecordBatch.from_arrays([part.column("at"), part.column("module"), part.column("slot"), part.column("width"), pa.array([len(x) for x in part.column("ids")], pa.int64()), pa.array(n2, pa.float64())], ["at", "module", "slot", "width", "n", "n2"])

        each = held.mapInArrow(lambda batches: map(norms, batches), "at string, module string, slot int, width int, n long, n2 double")
        slots = run.settle(each.groupBy("at", "module", "slot").agg(F.max("width").alias("width"), F.sum("n").alias("n"), F.sum("n2").alias("n2")), "slots")
        sizes = run.settle(slots.groupBy("module").agg(F.max("width").alias("width"), F.sum("n").alias("rows"), F.sum("n2").alias("norm2")), "sizes")
        most = (slots.agg(F.max("slot")).first()[0] or 0) + 1
        places = slots.select("at", "module")

        def started(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = []
            for module, width, n in zip(*(batch.column(c).to_pylist() for c in ("module", "width", "rows")), strict=True):
                shape = (width, min(extra, width, n))
                made.append(_held(np.linalg.qr(np.random.default_rng([seed, zlib.crc32(module.encode())]).standard_normal(shape))[0]))
            return pa.RecordBatch.from_arrays([batch.column("module"), batch.column("width"), pa.array(made, pa.binary())], ["module", "width", "v"])

        def straightened(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("module"), batch.column("width"), pa.array([_held(_next(z)) for z in batch.column("z").to_pylist()], pa.binary())], ["module", "width", "v"])

        kind = "module string, width int, v binary"
        v = run.settle(sizes.mapInArrow(lambda batches: map(started, batches), kind), "start")
        for _ in range(niter + 1):
            products = _by_slot(held, v.join(places, "module"), _both_sides)
            v = run.settle(_tree(products, most, _merged).join(sizes, "module").mapInArrow(lambda batches: map(straightened, batches), kind), "pass")

        def square(parts: list[bytes]) -> np.ndarray:
            return _triangle(np.concatenate([_read(p, round((len(p) / 8) ** 0.5)) for p in parts]))

        def leading(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for r in batch.to_pylist():
                directions = _read(r["v"], r["width"])
                s, turn = np.linalg.svd(_read(r["z"], directions.shape[1]))[1:]
                k = int(min(rank, r["rows"], r["width"]))
                s, basis = s[:k], directions @ turn[:k].T
                out.append((r["module"], k, r["width"], basis.ravel(), s, float((s**2).sum() / r["norm2"]) if r["norm2"] else 1.0, r["norm2"]))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], [c.split()[0] for c in BASIS.split(", ")])

        triangles = _tree(_by_slot(held, v.join(places, "module"), lambda d, y: _triangle(d @ y)), most, square)
        basis = run.settle(triangles.join(v.drop("width"), "module").join(sizes, "module").mapInArrow(lambda batches: map(leading, batches), BASIS), "basis", keep=True)
        more = None if finish is None else run.settle(finish(held, basis.join(places, "module")), "more", keep=True)
    return basis, more


UP = "module string, rank int, ids array<bigint>, up binary"


def up_blocks(alpha: float | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """For factored's finish: UP, the rows of each block's lora_up in one product, with the root of singular values and of rank / alpha folded in."""

    def run(part: pa.Table, basis: pa.Table) -> pa.Table:
        if not len(part) or not len(basis):
            return pa.table({"module": pa.array([], pa.string()), "rank": pa.array([], pa.int32()), "ids": pa.array([], pa.list_(pa.int64())), "up": pa.array([], pa.binary())})
        b = basis.to_pylist()[0]
        k = b["rank"]
        # a row times a right vector is its left vector's entry times the singular value
        root = np.sqrt(np.asarray(b["sigma"]))
        fold = np.where(root > 0, np.sqrt(k / (k if alpha is None else alpha)) / np.where(root > 0, root, 1), 0)
        directions = np.asarray(b["basis"]).reshape(b["width"], k) * fold
        up = [(np.frombuffer(x.as_buffer(), "<f4").reshape(-1, b["width"]).astype(np.float64) @ directions).astype("<f4").tobytes() for x in part.column("delta")]
        return pa.table({"module": part.column("module"), "rank": pa.array([k] * len(part), pa.int32()), "ids": part.column("ids"), "up": up})

    return lambda blocks, basis: blocks.groupBy("at").cogroup(basis.groupBy("at")).applyInArrow(run, UP)


def down_rows(basis: DataFrame, alpha: float | None = None) -> DataFrame:
    """(module, row, values, alpha): the rows of each module's lora_down."""

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                k = b["rank"]
                a = float(k if alpha is None else alpha)
                down = (np.asarray(b["basis"]).reshape(b["width"], k) * np.sqrt(np.asarray(b["sigma"]) * (k / a))).T.astype("f4")
                yield pa.RecordBatch.from_arrays([pa.array([b["module"]] * k), pa.array(range(k), pa.int64()), pa.array(list(down), pa.list_(pa.float32())), pa.array([a] * k)], ["module", "row", "values", "alpha"])

    return basis.mapInArrow(run, "module string, row long, values array<float>, alpha double")


def adapter(rows: DataFrame, rank: int = 32, alpha: float | None = None, oversample: int = 8, niter: int = 2, seed: int = 0, block: int = 256, slot_bytes: int = SLOT) -> tuple[DataFrame, DataFrame]:
    """(BASIS, the adapter's tensors as (key, row, values)): of each module .lora_up.weight by the matrix's rows, .lora_down.weight by rank, and .alpha; up @ down times alpha / rank approximates the delta."""
    basis, up = factored(blocks_of(rows, block, slot_bytes), rank, oversample, niter, seed, up_blocks(alpha))

    def unpacked(batches):
        for batch in batches:
            for r in batch.to_pylist():
                values = np.frombuffer(r["up"], "<f4").reshape(len(r["ids"]), -1)
                yield pa.RecordBatch.from_arrays([pa.array([r["module"] + ".lora_up.weight"] * len(values)), pa.array(r["ids"], pa.int64()), pa.array(list(values), pa.list_(pa.float32()))], ["key", "row", "values"])

    down = down_rows(basis, alpha)
    named = down.select(F.concat("module", F.lit(".lora_down.weight")).alias("key"), "row", "values")
    scale = down.filter("row = 0").select(F.concat("module", F.lit(".alpha")).alias("key"), F.lit(None).cast("long").alias("row"), F.array(F.col("alpha").cast("float")).alias("values"))
    return basis, up.mapInArrow(unpacked, "key string, row long, values array<float>").unionByName(named).unionByName(scale)


def energy_report(factors: DataFrame) -> DataFrame:
    return factors.agg(F.avg("energy").alias("mean"), F.min("energy").alias("min"), F.min_by("module", F.struct("energy", "module")).alias("worst"), F.count("*").alias("n"))
