"""Near duplicates by Order MinHash and banded alignment.

K-mers of three words carry their occurrence number. Each of M hash orders picks the L least k-mers of a text and keeps them in text order; two
texts agree on it with a chance that falls with edit similarity. K, M and L suit THRESHOLD: a fifth of the words, edited one here and one there,
leaves about a third of the k-mers in common, and 1 - (1 - J^L)^M is above 0.99 there. Texts that agree anywhere are candidates; a banded alignment over words decides:
similar if 1 - edits / length of the longer >= THRESHOLD.

Texts with the same words are one class, so copies cost nothing further. A bucket's hub is its smallest member. Members are first compared with
the smallest of their hubs that may be similar, then with the other hubs; links make components. In buckets that still hold several components beside
the hub, a few members of like lengths are compared with each other, and of more those that share a rare gram of one or two words at about the same
place, which all similar texts do: texts that only have a common passage aren't. Where a crowd shares a gram, blocks of its texts of like lengths meet
in one task each, first without their words, and no pair of texts is a row. Pairs
inside a known component aren't made, nor those that lengths or parities of word counts rule out. No link that joins components is lost within buckets.

Defined cases: texts without words are alone, each its own class; texts of fewer than three words have one k-mer of all of them; A-Z are folded;
rows that repeat a doc_id with the same words are one document, and share its mark; rows that repeat a doc_id with other words are other documents;
null doc_ids come after all others: a group of them alone has a null class_id, and the text with the least digest is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomset.llm.bloom import among
from loomset.llm.common import _powers, blocks, discard, mix, passing, ready, settle, shingles, utf8, words
from loomset.llm.components import components

K = 3
M = 48
L = 2
THRESHOLD = 0.8
#: Slots for the parities of word counts, at least, and of a long text for each word.
BITS = 512
SPREAD = 8
#: Cells of bands that are aligned together.
CELLS = 1 << 18
#: Members of a bucket, beside its hub and of like lengths, that are compared with each other at once.
FEW = 8
#: Slots in which grams are counted to tell rare from common ones, at least and at most, in how many ranges they're added up, and how many grams of a text travel in one row.
SLOTS, MOST_SLOTS = 1 << 16, 1 << 23
RANGES = 256
GRAMS = 32
#: Counts take a byte each, up to MANY: whole up to EXACT, beyond it in steps of an eighth of a doubling, so that common grams keep their order in larger inputs.
EXACT, MANY = 127, 255
#: Texts with one gram of which more are a crowd, and texts and words of a block of it: of their parities, in FOLD times less slots, and of themselves.
CROWD = 64
SIGNS, SIGN_WORDS, FOLD = 2048, 1 << 21, 4
BLOCK, BLOCK_WORDS = 256, 1 << 18
#: The part of all texts of a crowd that is one block.
WHOLE = -2
_TOP = np.uint64(2**64 - 1)
_UPPER = np.uint64(0xFFFFFFFF00000000)


def labelled(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """K-mers with the number of earlier occurrences in their row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.uint64)
    order = np.argsort(value ^ mix(row, 31), kind="stable")
    v, r = value[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0)) if len(v) else np.zeros(0, int)
    out = np.empty_like(value)
    out[order] = mix(v + (np.arange(len(v)) - lead).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 32)
    return out


def sketch(value: np.ndarray, first: np.ndarray, m: int = M, l: int = L) -> np.ndarray:  # noqa: E741
    """Rows x M: for each hash order a digest of the L least labelled k-mers, in text order. Rows without k-mers: zeros.

    A hash order is that of the upper halves of products with an odd number; the lower halves hold the places, so that minima bring them along.
    """
    n = len(first) - 1
    out = np.zeros((n, m), np.int64)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    kmers, begin = labelled(value, first), first[full]
    place, odd = np.arange(len(kmers), dtype=np.uint64), mix(np.arange(m, dtype=np.uint64), 100) | np.uint64(1)
    for j in range(m):
        order = kmers * odd[j]
        order &= _UPPER
        order |= place
        picked = np.empty((len(full), l), np.int64)
        for t in range(l):
            least = np.minimum.reduceat(order, begin)
            picked[:, t] = np.where(least == _TOP, len(kmers), least & ~_UPPER)
            order[picked[least != _TOP, t]] = _TOP
        picked.sort(axis=1)
        chosen = np.where(picked < len(kmers), kmers[np.minimum(picked, len(kmers) - 1)], np.uint64(0))
        digest = np.full(len(full), j + 1, np.uint64)
        for t in range(l):
            digest = mix(digest * np.uint64(0x9E3779B97F4A7C15) + chosen[:, t], 33)
        out[full, j] = digest.view(np.int64)
    return out


def parities(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parity of the number of labelled words in each of a power of two of slots, at least BITS and SPREAD for each word: flat, and the index of each row's first 64.

    An edit changes two of them at most. Slots are numbered so that the halves of a row's put upon each other are its parities in half as many.
    """
    n, count = len(first) - 1, np.diff(first)
    size = BITS // 64 << np.maximum(0, np.ceil(np.log2(np.maximum(1, count) * SPREAD / BITS))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(n), count)
    slot = begin[row] * 64 + (word & (size[row] * 64 - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(slot, minlength=begin[-1] * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64), begin


def narrowed(parity: np.ndarray, begin: np.ndarray, least: int = BITS // 64) -> np.ndarray:
    """Rows x least: each row's parities put upon each other down to 64 x least slots."""
    out = np.zeros((len(begin) - 1, least), np.int64)
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    np.bitwise_xor.at(out, (row, (np.arange(len(parity)) - begin[row]) % least), parity)
    return out


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences, or most + 1 if it's larger."""
    return int(all_edits([a], [b], np.array([most]))[0])


def all_edits(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of word sequences, or most + 1 where they're larger.

    The band of diagonals within `most` of the main one holds the path. For each number of edits, all diagonals of the bands of all pairs move
    together: each keeps how far along a its best alignment comes, and runs of equal words are passed in one go by halving over prefix hashes.
    """
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = most + 1
    out[(n == 0) | (m == 0)] = np.minimum(np.maximum(n, m), most + 1)[(n == 0) | (m == 0)]
    todo = np.flatnonzero((n > 0) & (m > 0) & (abs(n - m) <= most))
    todo = todo[np.argsort(most[todo], kind="stable")]
    while len(todo):  # pairs of like bands together, in bounded space
        size = max(1, int(np.searchsorted(np.arange(1, len(todo) + 1) * (2 * most[todo] + 3), CELLS, "right")))
        out[todo[:size]] = _banded([a[i] for i in todo[:size]], [b[i] for i in todo[:size]], most[todo[:size]])
        todo = todo[size:]
    return out


def _banded(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    at_a, at_b = np.cumsum(n) - n, np.cumsum(m) - m
    wa, wb = np.concatenate(a), np.concatenate(b)
    power, inverse = _powers(max(len(wa), len(wb)))
    sa, sb = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[: len(x)])]) for x in (wa, wb))

    def run(u: np.ndarray, v: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Lengths of the equal runs from wa[u] and wb[v], which are equal, within room."""
        low, high = np.ones(len(u), np.int64), room
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (sa[u + mid] - sa[u]) * inverse[u] == (sb[v + mid] - sb[v]) * inverse[v]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def passed(x: np.ndarray, k: np.ndarray, ok: np.ndarray) -> None:
        """Moves the places x on diagonals k over the equal words that follow, where ok."""
        p, d = np.nonzero(ok & (x < n[:, None]) & (x + k < m[:, None]))
        u, v = at_a[p] + x[p, d], at_b[p] + x[p, d] + k[d]
        same = wa[u] == wb[v]
        p, d, u, v = p[same], d[same], u[same], v[same]
        if len(p):
            x[p, d] += run(u, v, np.minimum(at_a[p] + n[p] - u, at_b[p] + m[p] - v))

    out, own, widest, never = most + 1, np.arange(len(n)), int(most.max()), -(1 << 40)
    far = np.full((len(n), 2 * widest + 3), never)  # cell d stands for the diagonal b's place - a's place = d - widest - 1
    start = np.zeros((len(n), 1), np.int64)
    passed(start, np.zeros(1, np.int64), np.ones((len(n), 1), bool))
    far[:, widest + 1] = start[:, 0]
    for e in range(widest + 1):
        done = far[np.arange(len(n)), m - n + widest + 1] >= n
        out[own[done]] = e
        go = ~done & (most > e)
        if not go.all():
            own, n, m, at_a, at_b, most, far = (x[go] for x in (own, n, m, at_a, at_b, most, far))
            if not len(own):
                break
        left = most - e - 1  # edits that remain after this one: diagonals further from the goal are given up
        low, high = max(-e - 1, int((m - n - left).min())), min(e + 1, int((m - n + left).max()))
        if low > high:
            break
        k = np.arange(low, high + 1)
        at = slice(low + widest + 1, high + widest + 2)
        x = np.maximum(np.maximum(far[:, at] + 1, far[:, at.start + 1 : at.stop + 1] + 1), far[:, at.start - 1 : at.stop - 1])
        x = np.minimum(np.minimum(x, n[:, None]), m[:, None] - k)
        ok = (x >= 0) & (x + k >= 0) & (abs(k - (m - n)[:, None]) <= left[:, None])
        passed(x, k, ok)
        far[:] = never
        far[:, at] = np.where(ok, x, never)
    return out


def similar(a: list[np.ndarray], b: list[np.ndarray], least: float) -> np.ndarray:
    """Whether 1 - edits / longer is at least `least`, for pairs of word sequences."""
    bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bag(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if id(x) not in bags:
            bags[id(x)] = np.unique(x, return_counts=True)
        return bags[id(x)]

    longer = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    most, maybe = np.floor((1 - least) * longer + 1e-9).astype(np.int64), np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if abs(len(x) - len(y)) <= most[i]:  # words in common bound the distance from below
            (va, ca), (vb, cb) = bag(x), bag(y)
            at = np.minimum(np.searchsorted(vb, va), max(0, len(vb) - 1))
            maybe[i] = longer[i] - (np.minimum(ca, cb[at])[vb[at] == va].sum() if len(vb) else 0) <= most[i]
    rows = np.flatnonzero(maybe)
    maybe[rows] = all_edits([a[i] for i in rows], [b[i] for i in rows], most[rows]) <= most[rows]
    return maybe


DIGESTS = [T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())]
SKETCH = [*DIGESTS, T.StructField("n_words", T.LongType()), T.StructField("parity", T.ArrayType(T.LongType())), T.StructField("parities", T.ArrayType(T.LongType())), T.StructField("bands", T.ArrayType(T.LongType()))]


def _digests(h: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Two digests of each row's words."""
    count = np.diff(first)
    place, out = (np.arange(len(h)) - np.repeat(first[:-1], count)).astype(np.uint64), []
    for seed in (41, 42):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(mix(h, seed) + place * np.uint64(0x9E3779B97F4A7C15), seed + 2))])
        out.append(pa.array(mix(total[first[1:]] - total[first[:-1]] + count.astype(np.uint64), seed).view(np.int64)))
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))


def sketches(docs: DataFrame, m: int = M, l: int = L, k: int = K) -> DataFrame:  # noqa: E741
    """(doc_id, d1 and d2: digests of the words, n_words, parities, and parity: these narrowed to BITS, bands)."""
    ready(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], *SKETCH])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, limits in blocks(batches):
            _, _, h, first = words(data, limits)
            bands = sketch(*shingles(h, first, k), m, l)
            odd, begin = parities(labelled(h, first), first)
            lists = [_lists(narrowed(odd, begin)), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(odd)), _lists(bands)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([batch.column("doc_id"), *_digests(h, first), pa.array(np.diff(first)), *lists], arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digested(docs: DataFrame, names: tuple[str, str] = ("d1", "d2")) -> DataFrame:
    """docs with the digests of the words of text, in columns of these names."""
    ready(docs.sparkSession)
    schema = T.StructType([*docs.schema, *[T.StructField(c, T.LongType()) for c in names]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, limits in blocks(batches):
            _, _, h, first = words(data, limits)
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*batch.columns, *_digests(h, first)], arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, schema)


def _ends(pairs: DataFrame) -> DataFrame:
    return settle(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), "ends")


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) whose texts are similar. texts: (cls, text)."""
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own(node: pa.Array, text: pa.Array) -> list[np.ndarray]:
            """Each row's words; a text that stands in several rows is split once."""
            _, lead, at = np.unique(np.asarray(node), return_index=True, return_inverse=True)
            _, _, h, first = words(*utf8(text.take(pa.array(lead))))
            each = [h[first[i] : first[i + 1]] for i in range(len(lead))]
            return [each[i] for i in at]

        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                keep = pa.array(np.flatnonzero(similar(own(batch.column("a"), batch.column("ta")), own(batch.column("b"), batch.column("tb")), least)))
                yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=out.names)

    maybe = among(_ends(pairs), "cls")  # most texts are in no pair, and stay where they lie
    texts = texts.filter(maybe("cls"))
    joined = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(align, out)


def _grams(h: np.ndarray, first: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the q-grams of words within rows, the row and the place of each."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - first[row]
    keep = place + q <= n[row]
    value = mix(h, 50 + q)
    for j in range(1, q):
        value[:-j] = mix(value[:-j] * np.uint64(0x9E3779B97F4A7C15) + h[j:], 50 + q)
    return value[keep], row[keep], place[keep]


def _leading(value: np.ndarray, row: np.ndarray, place: np.ndarray, frequency: np.ndarray, spoilt: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row its rarest grams until those before them are more than it may lose: row, gram, first and last place, frequency, and whether another row may have it."""
    times = frequency[(value & np.uint64(len(frequency) - 1)).astype(np.int64)]
    order = np.lexsort((value, times, row))
    v, r, t, p = value[order], row[order], times[order], place[order]
    new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])]) if len(v) else np.zeros(0, np.int64)
    low, high = (np.minimum.reduceat(p, new), np.maximum.reduceat(p, new)) if len(new) else (new, new)
    own = np.diff(np.append(new, len(v)))
    v, r, t = v[new], r[new], t[new]
    keep = new - new[np.searchsorted(r, r)] <= spoilt[r] if len(new) else np.zeros(0, bool)
    return r[keep], v[keep], low[keep], high[keep], t[keep], (t > own)[keep] | (t[keep] > EXACT)


def _stepped(n: np.ndarray) -> np.ndarray:
    """Counts in steps, in the same order."""
    return np.where(n <= EXACT, n, EXACT + np.ceil(8 * np.log2(np.maximum(n, 1) / EXACT))).astype(np.int64)


def gram_counts(texts: DataFrame, slots: int, steps: Callable[[np.ndarray], np.ndarray] = np.asarray) -> np.ndarray:
    """2 x slots: how many grams of one and of two words of `text` fall in each slot, in these steps, up to MANY."""
    width = 2 * slots // RANGES

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, limits in blocks(batches):
            _, _, h, first = words(data, limits)
            found = np.concatenate([(_grams(h, first, q)[0] & np.uint64(slots - 1)).astype(np.int32) + (q - 1) * slots for q in (1, 2)])
            slot, n = np.unique(found, return_counts=True)
            some, begin = np.unique(slot // width, return_index=True)
            held = [x.astype(np.int32).tobytes() for x in np.split(np.stack([slot, n], 1), begin[1:])] if len(slot) else []
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held, pa.binary())], names=["range", "held"])

    def add(rows: pa.Table) -> pa.Table:
        part, n = rows.column("range")[0].as_py(), np.zeros(width, np.int64)
        for x in rows.column("held"):
            slot, own = np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2).T
            n[slot - part * width] += own
        return pa.table({"range": [part], "n": pa.array([np.minimum(steps(n), MANY).astype(np.uint8).tobytes()], pa.binary())})

    out = np.zeros((RANGES, width), np.uint8)
    for r in texts.select("text").mapInArrow(place, "range long, held binary").groupBy("range").applyInArrow(add, "range long, n binary").toArrow().to_pylist():
        out[r["range"]] = np.frombuffer(r["n"], np.uint8)
    return out.reshape(2, slots)


def rare_grams(texts: DataFrame, least: float, counted: DataFrame | None = None, slots: int = SLOTS) -> DataFrame:
    """texts with `text` -> its other columns, q, and up to GRAMS rare grams of q words (1 or 2) in a row: gram, with its first (low) and last (high) place. Grams that only one text has are left out.

    An edit spoils at most q of a text's q-grams, so of similar texts at most a share of 1 - least of the words, times q, is without a counterpart
    at about the same place in the other. In any order of grams that is the same for all texts, the first of the others stands among the first so many and
    one, in both. The order is by frequency, counted in slots over all these texts (or over `counted`, which has all of them and maybe more), so common passages
    come last. A text uses two words where the leading ones aren't much more frequent than all are or than its leading single words; a pair of texts meets by
    the lesser of their q.
    """
    ready(texts.sparkSession)
    rest = [x for x in texts.schema if x.name != "text"]
    long = lambda c: T.StructField(c, T.ArrayType(T.LongType()))
    out = T.StructType([*rest, T.StructField("most_q", T.LongType()), T.StructField("q", T.LongType()), long("gram"), long("low"), long("high")])
    arrow = to_arrow_schema(out)
    frequency = gram_counts(texts if counted is None else counted, slots, _stepped)
    load, shared = 4 * frequency[1].mean(), texts.sparkSession.sparkContext.broadcast(frequency)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, limits in blocks(batches):
            _, _, h, first = words(data, limits)
            n = np.diff(first)
            parts, worst = [], np.zeros((2, len(n)), np.int64)
            for q in (1, 2):
                parts.append(_leading(*_grams(h, first, q), shared.value[q - 1], np.floor((1 - least) * q * n + 1e-9)))
                np.maximum.at(worst[q - 1], parts[-1][0], parts[-1][4])
            most_q = np.where((worst[1] <= np.maximum(worst[0], load)) & (n - 1 > np.floor((1 - least) * 2 * n + 1e-9)), 2, 1)
            for q, (r, v, low, high, _, met) in zip((1, 2), parts, strict=True):
                some = (q <= most_q[r]) & met
                r, v, low, high = r[some], v[some], low[some], high[some]
                begin = np.searchsorted(r, r)  # each text's first
                cut = np.flatnonzero((np.arange(len(r)) - begin) % GRAMS == 0)
                offsets, own = pa.array(np.append(cut, len(r)).astype(np.int32)), r[cut]
                at = pa.array(own)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)).cast(arrow.field("gram").type) for x in (v.view(np.int64), low, high)]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).take(at).cast(arrow.field(f.name).type) for f in rest], pa.array(most_q[own]), pa.array(np.full(len(own), q)), *lists], schema=arrow)

    return texts.select("text", *[f.name for f in rest]).mapInArrow(lead, out)


def _differing(px: str, py: str) -> Column:
    return sum((F.bit_count(F.col(px)[i].bitwiseXOR(F.col(py)[i])) for i in range(BITS // 64)), F.lit(0))


def _differing_whole(px: str, py: str) -> Column:
    """As _differing, of parities in more slots; those in twice as many are put upon each other first."""
    few = F.least(F.size(px), F.size(py))
    fold = lambda p: F.when(F.size(p) > few, F.zip_with(F.slice(p, F.lit(1), few), F.slice(p, few + 1, few), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(p))
    return F.aggregate(F.zip_with(fold(px), fold(py), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)


def _reach(nx: str, ny: str, least: float) -> Column:
    """Edits that similar texts of nx and ny words have at most."""
    return F.floor((1 - least) * F.greatest(nx, ny) + 1e-9)


def _possible(nx: str, ny: str, px: str, py: str, least: float) -> Column:
    """Whether texts of nx and ny words with parities px and py may be similar: an edit changes two parities, or one and the length."""
    return (F.abs(F.col(nx) - F.col(ny)) <= _reach(nx, ny, least)) & (_differing(px, py) <= 2 * _reach(nx, ny, least) - F.abs(F.col(nx) - F.col(ny)))


def _by_hubs(classes: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of members and hubs that may be similar; for each member (key) those with more buckets in common rank first."""
    alike = members.filter((F.col("cls") != F.col("hub")) & (F.abs(F.col("n_words") - F.col("hub_words")) <= _reach("n_words", "hub_words", least)))
    met = alike.groupBy(F.col("hub").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("n"))
    own = lambda c: classes.select(F.col("cls").alias(c), F.col("n_words").alias(f"n_words_{c}"), F.col("parity").alias(f"parity_{c}"))
    may = met.join(own("a"), "a").join(own("b"), "b").filter(_possible("n_words_a", "n_words_b", "parity_a", "parity_b", least))
    return settle(may.select("a", "b", F.struct("b").alias("key"), (-F.col("n")).alias("rank")), "pairs")


def _promising(met: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Of met (a, b, label: that of b) the pairs whose lengths and parities allow them to be similar: (a, b, key: a and label, rank: parities that differ)."""
    maybe = among(_ends(met), "cls")
    known = settle(classes.filter(maybe("cls")).select("cls", "n_words", "parity", "parities"), "known")
    own = lambda c: known.select(F.col("cls").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in known.columns[1:]])
    differing = _differing_whole("parities_a", "parities_b")
    room = 2 * _reach("n_words_a", "n_words_b", least) - F.abs(F.col("n_words_a") - F.col("n_words_b"))
    may = met.join(own("a"), "a").join(own("b"), "b").filter(_possible("n_words_a", "n_words_b", "parity_a", "parity_b", least) & (differing <= room))
    return settle(may.select("a", "b", F.struct(F.col("a").alias("cls"), "label").alias("key"), differing.alias("rank")), "pairs")


def _by_few(held: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different labels in one bucket and cell that may be similar; of a text with a label (key) those whose words differ least rank first. held: FEW rows or less of each bucket and cell."""
    side = lambda c: held.select("bucket", "cell", F.col("cls").alias(c), F.col("label").alias(f"label_{c}"), F.col("n_words").alias(f"n_{c}"))
    alike = (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & (F.abs(F.col("n_a") - F.col("n_b")) <= _reach("n_a", "n_b", least))
    met = settle(side("a").join(side("b"), ["bucket", "cell"]).filter(alike).select("a", "b", F.col("label_b").alias("label")).distinct(), "met")
    return _promising(met, classes, least)


def _cell(least: float) -> Column:
    """A number for n_words: those of similar texts are the same or neighbours."""
    return (F.floor(F.log(F.col("n_words") + F.lit(0.5)) / float(-np.log(least))) if least < 1 else F.col("n_words")).cast("int")


def _folded(parities: Column) -> Column:
    """Parities put upon each other down to FOLD times less slots, BITS at least: texts with too few words in common still differ in too many of them."""
    few = F.greatest(F.lit(BITS // 64), F.floor(F.size(parities) / FOLD)).cast("int")
    upon = lambda i: F.aggregate(F.sequence(F.lit(0), F.floor(F.size(parities) / few).cast("int") - 1), F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(parities[i + k * few]))
    return F.transform(F.sequence(F.lit(0), few - 1), upon)


def _earlier(mine: pa.Array) -> np.ndarray:
    """A bit for each of these grams that several texts have: rows x 64 of them."""
    row = np.repeat(np.arange(len(mine)), np.asarray(mine.value_lengths()))
    _, at, n = np.unique(np.asarray(mine.flatten()), return_inverse=True, return_counts=True)
    row, at = row[n[at] > 1], (np.cumsum(n > 1) - 1)[at][n[at] > 1]
    out = np.zeros((len(mine), max(1, -(-int((n > 1).sum()) // 64))), np.uint64)
    np.bitwise_or.at(out, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def _alike(rows: pa.Table, n: np.ndarray, parity: np.ndarray, size: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of two blocks' texts, or of one's: a text, those of other labels that lengths and parities allow to be similar to it, and the parities that differ. size: of each text's."""
    col = lambda c: rows.column(c).combine_chunks()
    one = lambda c: rows.column(c)[0].as_py()
    side, label, most_q, q, within = np.asarray(col("side")), np.asarray(col("label")), np.asarray(col("most_q")), one("q"), one("low") == one("high") and one("i") == one("j")
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if within else 1))
    if not len(left) or not len(right) or len(np.unique(label)) < 2:
        return
    bits, at = {}, {}  # of texts with parities in so many slots or more, narrowed to these, and where each text's are
    for few in np.unique(size):
        some = size >= few
        own = narrowed(parity[np.repeat(some, size)], np.concatenate([[0], np.cumsum(size[some])]), int(few))
        bits[few], at[few] = own.view(np.uint64), np.cumsum(some) - 1  # bits of negative numbers would be counted without their sign
    earlier = _earlier(col("mine"))
    for i in left:
        may = (label[right] != label[i]) & (abs(n[i] - n[right]) <= np.floor((1 - least) * np.maximum(n[i], n[right]) + 1e-9)) & (np.minimum(most_q[i], most_q[right]) == q)
        may &= right > i if within else True
        met = right[may]
        both = np.minimum(size[i], size[met])
        for few in np.unique(both):
            j = met[both == few]
            differ = np.bitwise_count(bits[few][at[few][i]] ^ bits[few][at[few][j]]).sum(1)
            some = differ <= 2 * np.floor((1 - least) * np.maximum(n[i], n[j]) + 1e-9) - abs(n[i] - n[j])
            j, differ = j[some], differ[some]
            # texts that share several crowded grams meet at the first
            some = ~(earlier[i] & earlier[j]).any(1)
            yield i, j[some], differ[some]


def _marked(rows: pa.Table, least: float) -> np.ndarray:
    """Which texts of two blocks, or of one, may be similar to another there, by their folded parities."""
    few = rows.column("few").combine_chunks()
    out = np.zeros(len(rows), bool)
    for i, j, _ in _alike(rows, np.asarray(rows.column("n_words").combine_chunks()), np.asarray(few.flatten()), np.asarray(few.value_lengths()), least):
        out[j] = True
        out[i] |= len(j) > 0
    return out


def _linked(rows: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Labels that similar texts of two blocks, or of one, join."""
    label = np.asarray(rows.column("label").combine_chunks())
    _, _, h, first = words(*utf8(rows.column("text")))
    n = np.diff(first)
    parity, begin = parities(labelled(h, first), first)
    found = [np.zeros((3, 0), np.int64), *(np.array([np.full(len(j), i), j, differ], np.int64) for i, j, differ in _alike(rows, n, parity, np.diff(begin), least))]
    a, b, differ = np.concatenate(found, axis=1)
    order = np.argsort(differ, kind="stable")
    a, b = a[order], b[order]
    each = [h[first[i] : first[i + 1]] for i in range(len(n))]
    names, own = np.unique(label, return_inverse=True)
    root, links = np.arange(len(names)), []
    left = np.unique(own[a] * len(names) + own[b], return_index=True)[1]  # of two labels the pair whose words differ least, then the others
    for todo in (left, np.setdiff1d(np.arange(len(a)), left)):
        for i in range(0, len(todo), 256):
            some = todo[i : i + 256]
            some = some[root[own[a[some]]] != root[own[b[some]]]]
            some = some[similar([each[x] for x in a[some]], [each[x] for x in b[some]], least)]
            for x, y in zip(own[a[some]], own[b[some]], strict=True):
                if root[x] != root[y]:
                    links.append((names[x], names[y]))
                    root[root == root[y]] = root[x]
    return tuple(np.array(links, np.int64).reshape(-1, 2).T)


#: A block meets another, or itself, in one task.
MEETING = ("gram", "low", "high", "i", "j")


def _in_blocks(crowded: DataFrame, held: DataFrame, most: int, most_words: int, least: float) -> DataFrame:
    """crowded's columns, mine: the text's crowded grams below this one, and its columns in held, by cls: once for each meeting of its block, of which it's on a side (0 or 1).

    A crowd of `most` texts and `most_words` words at most is one block. Of larger ones the texts of a length are dealt to blocks, those of the commonest label
    to their own, which don't meet each other. A block meets those of its length and of neighbouring ones.
    """
    own = ("cls", "label", "n_words", "most_q", "q")
    mine = crowded.groupBy(*own).agg(F.collect_list(F.struct("gram", "main")).alias("at"))
    rows = mine.select(*own, F.col("at.gram").alias("mine"), F.explode("at").alias("at")).select(*own, "mine", "at.*")
    rows = rows.withColumn("mine", F.filter("mine", lambda g: g < F.col("gram")))
    lengths = 2 * _cell(least) + (F.col("label") == F.col("main")).cast("int")
    rows = settle(rows.withColumn("part", lengths), "crowds")
    blocks_of = lambda texts, words: F.ceil(F.greatest(texts / most, words / most_words)).cast("int")
    sizes = crowded.withColumn("part", lengths).groupBy("gram", "part").agg(F.count("*").alias("texts"), F.sum("n_words").alias("words"))
    each = F.map_from_entries(F.collect_list(F.struct("part", blocks_of(F.col("texts"), F.col("words")))))
    sizes = sizes.groupBy("gram").agg(blocks_of(F.sum("texts"), F.sum("words")).alias("all"), each.alias("n"))
    sizes = settle(sizes.select("gram", F.when(F.col("all") > 1, F.col("n")).otherwise(F.create_map(F.lit(WHOLE), "all")).alias("n")), "sizes")
    block = F.pmod(F.xxhash64("cls"), F.col("n")[F.col("part")]).cast("int")
    maybe = among(rows, "cls")
    rows = rows.join(sizes, "gram").withColumn("part", F.when(F.map_contains_key("n", F.lit(WHOLE)), WHOLE).otherwise(F.col("part"))).withColumn("block", block).join(held.filter(maybe("cls")), "cls")
    part, block, cell = F.col("part"), F.col("block"), F.floor(F.col("part") / 2).cast("int")
    peers = F.filter(F.transform(F.sequence(2 * cell - 2, 2 * cell + 3), lambda p: F.struct(p.alias("part"), F.coalesce(F.col("n")[p], F.lit(0)).alias("n"))), lambda p: (p["n"] > 0) & ((part % 2 == 0) | (p["part"] % 2 == 0)))

    def meeting(p: Column, j: Column) -> Column:
        ahead = (part < p) | ((part == p) & (block <= j))
        low, high, i, k = F.when(ahead, part).otherwise(p), F.when(ahead, p).otherwise(part), F.when(ahead, block).otherwise(j), F.when(ahead, j).otherwise(block)
        return F.struct(low.alias("low"), high.alias("high"), i.alias("i"), k.alias("j"), F.when(ahead, 0).otherwise(1).alias("side"))

    met = F.flatten(F.transform(peers, lambda p: F.transform(F.sequence(F.lit(0), p["n"] - 1), lambda j: meeting(p["part"], j))))
    carried = (*crowded.columns, "mine", *[c for c in held.columns if c != "cls"])
    return rows.select(*carried, F.explode(met).alias("m")).select(*carried, "m.*")


def _by_crowds(crowded: DataFrame, signs: DataFrame, texts: DataFrame, least: float) -> DataFrame | None:
    """Links (a, b) between the labels of similar texts that share a crowded gram, or None. crowded: (gram, main, cls, label, n_words, most_q, q); signs: (cls, few: folded parities).

    Most texts of a crowd have nothing but its gram in common, so the blocks that meet first have parities alone, and are large. Only texts that these allow
    to be similar to another of the crowd travel, once for each block they meet, not for each text.
    """

    columns = crowded.columns

    def mark(rows: pa.Table) -> pa.Table:
        return rows.select(columns).filter(pa.array(_marked(rows, least)))

    def compare(rows: pa.Table) -> pa.Table:
        a, b = _linked(rows, least)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    crowded = settle(_in_blocks(crowded, signs, SIGNS, SIGN_WORDS, least).groupBy(*MEETING).applyInArrow(mark, crowded.schema).distinct(), "alike")
    if not crowded.limit(1).count():
        return None
    return settle(_in_blocks(crowded, texts, BLOCK, BLOCK_WORDS, least).groupBy(*MEETING).applyInArrow(compare, "a long, b long").distinct(), "links")


def _by_grams(open_: DataFrame, texts: DataFrame, least: float) -> tuple[DataFrame | None, DataFrame]:
    """Links (a, b) between labels in crowds, and pairs (a, b) of different labels that have another rare gram in common and may be similar; of a text with a label (key) those whose words differ least rank first.

    open_: (cls, label, n_words, parity, parities). Similar texts have such a gram in common themselves, whatever their labels, so a text meets CROWD others
    at most at a gram that makes rows, and those of a crowd in blocks (_by_crowds).
    """
    maybe, n = among(open_, "cls"), open_.agg(F.sum("n_words")).first()[0] or 0
    some = texts.filter(maybe("cls"))
    slots = min(MOST_SLOTS, max(SLOTS, 1 << int(np.ceil(np.log2(2 * max(1, n))))))
    rows = settle(rare_grams(some.repartition("cls").join(open_.drop("parities"), "cls"), least, some, slots), "rare")
    # rows hold few grams each, so dealing them out again evens what long and short texts make
    rows = rows.repartition(F.hash("cls", "gram"))
    met = rows.select("label", "most_q", "q", F.explode("gram").alias("gram")).groupBy("gram", "label").agg(F.count("*").alias("n"), F.min("most_q").alias("most_q"), F.first("q").alias("q"))
    shared = met.groupBy("gram").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("n"), F.min("most_q").alias("most_q"), F.first("q").alias("q"))
    shared = settle(shared.filter("labels > 1 AND q = most_q").select("gram", "main", (F.col("n") > CROWD).alias("crowd")), "shared")
    maybe = among(shared, "gram")
    own = ("cls", "label", "n_words", "parity", "most_q", "q")
    each = settle(rows.select(*own, F.explode(F.arrays_zip("gram", "low", "high")).alias("g")).select(*own, "g.*").filter(maybe("gram")).join(shared, "gram"), "grams")
    crowded, signs = each.filter("crowd").select("gram", "main", "cls", "label", "n_words", "most_q", "q"), open_.select("cls", _folded(F.col("parities")).alias("few"))
    links = _by_crowds(crowded, signs, texts, least) if shared.filter("crowd").limit(1).count() else None
    own = ("label", "n_words", "parity", "most_q", "q", "low", "high")
    side = lambda c: each.filter("NOT crowd").select("gram", F.col("cls").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in own])
    reach = _reach("n_words_a", "n_words_b", least)
    meet = (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & (F.col("q_a") == F.least("most_q_a", "most_q_b")) & _possible("n_words_a", "n_words_b", "parity_a", "parity_b", least)
    meet = meet & (F.col("low_a") - reach <= F.col("high_b")) & (F.col("low_b") - reach <= F.col("high_a"))
    met = settle(side("a").join(side("b"), "gram").filter(meet).select("a", "b", F.col("label_b").alias("label")).distinct(), "met")
    return links, _promising(met, open_, least)


def _further(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("label"), F.col("label").alias("further"))


def _relabelled(labels: DataFrame, further: DataFrame) -> DataFrame:
    return settle(labels.join(further, "label", "left").select("cls", F.coalesce("further", "label").alias("label")), "labels")


def _contracted(pairs: DataFrame, labels: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """labels (cls, label) after the pairs (a, b, key, rank) that are similar join components: first of each key the pair of the least rank, then the others that are still apart."""
    ends = [labels.select(F.col("cls").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b")]
    left = settle(pairs.join(ends[0], "a").join(ends[1], "b").filter("label_a <> label_b"), "left")
    for ahead in (True, False):
        apart = left
        if ahead:
            apart = settle(left.groupBy("key").agg(F.min_by(F.struct("a", "b", "label_a", "label_b"), F.struct("rank", "a", "b")).alias("p")).select("p.*"), "apart")
        if not apart.limit(1).count():
            break
        similar = verify(apart.select("a", "b"), texts, least)
        links = settle(similar.join(apart, ["a", "b"]).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "links")
        further = _further(links)
        labels = _relabelled(labels, further)
        if ahead:  # compared pairs are done with, and the others' labels follow the links
            left = left.join(apart.select("a", "b"), ["a", "b"], "left_anti")
            for c in ("label_a", "label_b"):
                left = left.join(further.withColumnRenamed("label", c), c, "left").withColumn(c, F.coalesce("further", c)).drop("further")
            left = settle(left.filter("label_a <> label_b"), "left")
    return labels


def near_duplicates(docs: DataFrame, least: float = THRESHOLD, m: int = M, l: int = L, k: int = K) -> DataFrame:  # noqa: E741
    """(doc_id, d1 and d2: digests of the words, n_words, class_id: smallest doc_id of its group, class_size in rows, kept), a table; all others made on the way are gone."""
    with passing(docs.sparkSession):
        return settle(_classes(docs.select("doc_id", "text"), least, m, l, k), "near", keep=True)


def _classes(docs: DataFrame, least: float, m: int, l: int, k: int) -> DataFrame:  # noqa: E741
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"))
    sketched = settle(sketches(docs, m, l, k), "sketches")
    # a class is all rows of the same words; its number is written down with it, so it stays
    worded, own = sketched.filter("n_words > 0"), ("n_words", "parity", "parities", "bands")
    repeated = settle(worded.groupBy("d1", "d2").agg(F.count("*").alias("n")).filter("n > 1").select("d1", "d2"), "repeated")
    again = among(repeated, "d1", "d2")  # sketches of other words are classes where they lie
    marked = worded.withColumn("again", again("d1", "d2"))
    classes = marked.filter("again").groupBy("d1", "d2").agg(F.min(order).alias("at"), *[F.first(c).alias(c) for c in own])
    classes = marked.filter("NOT again").select("d1", "d2", order.alias("at"), *own).unionByName(classes)
    classes = settle(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    ids = settle(sketched.select("doc_id", "d1", "d2", "n_words"), "ids")
    discard(sketched)  # sketches are the largest tables by far
    placed = classes.select("cls", "n_words", F.explode("bands").alias("bucket"))
    # only bucket numbers are shuffled to find those of several classes, few of all
    several = settle(placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "several")
    maybe = among(several, "bucket")
    some = settle(placed.filter(maybe("bucket")), "placed")
    hubs = some.groupBy("bucket").agg(F.min(F.struct(F.col("cls").alias("hub"), F.col("n_words").alias("hub_words"))).alias("hub"), F.max("cls").alias("last"))
    members = settle(some.join(hubs.filter("hub.hub < last").select("bucket", "hub.*"), "bucket"), "members")
    banded, classes = classes, settle(classes.drop("bands"), "classes")
    discard(banded)
    wanted = settle(members.select("cls").distinct().join(classes.select("cls", "d1", "d2", "at.doc_id"), "cls"), "wanted")
    maybe = among(wanted.select("doc_id"), "doc_id")
    # the ids are compared after the join: as a key they would have texts shuffled again for their groups
    texts = digested(docs.filter(maybe("doc_id"))).join(wanted.withColumnRenamed("doc_id", "rep"), ["d1", "d2"])
    texts = texts.groupBy("d1", "d2", "cls").agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("rep")), F.col("text"))).alias("text"))
    texts = settle(texts.filter("text IS NOT NULL").select("cls", "text"), "texts")
    labels = _contracted(_by_hubs(classes, members, least), wanted.select("cls", F.col("cls").alias("label")), texts, least)
    # then what may join components that meet in a bucket beside its hub, which all members were compared with
    held = settle(members.filter("cls <> hub").select("bucket", "cls", "n_words").join(labels, "cls"), "held")
    # each text stands in its own cell of lengths and the next
    held = held.withColumn("cell", F.explode(F.array(_cell(least), _cell(least) + 1)))
    split = held.groupBy("bucket", "cell").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low < high").select("bucket", "cell", "n")
    held = settle(held.join(split, ["bucket", "cell"]), "split")
    labels = _contracted(_by_few(held.filter(F.col("n") <= FEW), classes, least), labels, texts, least)
    many = settle(held.filter(F.col("n") > FEW).select("cls").distinct().join(labels, "cls"), "many")
    open_ = settle(many.join(classes.select("cls", "n_words", "parity", "parities"), "cls"), "open")
    links, pairs = _by_grams(open_, texts, least)
    if links is not None:
        labels = _relabelled(labels, _further(links))
    labels = _contracted(pairs, labels, texts, least)
    # the class_id is the smallest doc_id; the document that stays is that of this id with the least digest
    named = wanted.select("cls", "d1", "d2", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id")).alias("at")).join(labels, "cls")
    first = named.groupBy("label").agg(F.min(F.struct("at", "d1", "d2")).alias("first"), F.count("*").alias("classes")).filter("classes > 1")
    moved = named.join(first, "label").select("d1", "d2", "first")
    alone = classes.select("d1", "d2", F.struct("at", "d1", "d2").alias("own"))
    known = settle(alone.join(moved, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("first", "own").alias("first")), "known")
    rows = settle(ids.join(known, ["d1", "d2"], "left"), "rows")
    full = rows.filter("n_words > 0").select("doc_id", "d1", "d2", "n_words", F.col("first.at.doc_id").alias("class_id"), F.struct("first.d1", "first.d2").alias("group"), (F.struct("d1", "d2") == F.struct("first.d1", "first.d2")).alias("same"))
    sizes = settle(full.groupBy("group").agg(F.count("*").alias("class_size")).filter("class_size > 1"), "sizes")
    out = full.join(sizes, "group", "left").select("doc_id", "d1", "d2", "n_words", "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (F.col("same") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))
    alone = rows.filter("n_words = 0").select("doc_id", "d1", "d2", "n_words", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, **sketch: float) -> DataFrame:
    """docs less all rows of each group but one: those of the document that is kept; of rows that repeat its id and words, the first met.

    Rows are told by doc_id and words together, so a doc_id on unlike texts costs none of them. Texts without words all stay.
    """
    found = near_duplicates(docs, **sketch)
    gone = found.filter("NOT kept").select("doc_id", "d1", "d2", F.lit(False).alias("stays")).distinct()
    again = found.filter("kept AND n_words > 0").groupBy("doc_id", "d1", "d2").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "d1", "d2", F.lit(True).alias("stays"))
    touched = settle(gone.unionByName(again), "touched")
    # the caller's columns stand in one, so that no name of theirs meets one of ours
    rows = digested(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    maybe = among(touched, "doc_id", "d1", "d2")
    marked = rows.withColumn("maybe", maybe("doc_id", "d1", "d2"))
    known = touched.withColumnsRenamed({c: f"_{c}" for c in ("doc_id", "d1", "d2")})
    altered = marked.filter("maybe").join(known, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
    altered = settle(altered.filter("stays IS NULL OR stays").select("doc_id", "d1", "d2", "stays", "row"), "altered")
    once = altered.filter("stays").groupBy("doc_id", "d1", "d2").agg(F.first("row").alias("row"))
    return marked.filter("NOT maybe").select("row").unionByName(altered.filter("stays IS NULL").select("row")).unionByName(once.select("row")).select("row.*")


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", "kept")
