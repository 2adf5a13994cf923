"""Source divergence audit: how far each source's word distribution is from every other source of its language, and which terms it overuses.

The groups (lang, source) of a language are dealt to teams, and terms to pieces by their hash. A team's counts in a piece are one cell, packed and
compressed, that stays in its bucket of a bucketed table; cells meet in the rounds of a round-robin tournament: in every round each team's cell
meets the one that the circle method names, and only the visitors' cells are shuffled, while the hosts' are read where they lie. A meeting scores
both directions of every pair of groups. Before the rounds each cell is at home: pairs within a team are scored, and a heap for each group keeps
its best terms against the language. A round's sums are written to the shared folder, so a lost executor costs one round.

For a group with N kept words, a term that occurs c times has p = 1 + floor(UNIT * (c + 1) / (N + V)), where V is the number of the language's kept
terms; a language's own q follows alike from all its words. All is integers: the quotient comes from long division in steps of a thousand, which
holds while N + V < 2**53. Terms that neither group has are not enumerated: they all give the same value, and are counted.

Sizes: a cell has `cell` entries at most, about, whatever the number of terms, because the number of pieces follows from the counts; a hot source
is cut by terms like any other. Words are counted in each block of texts before they are shuffled. Teams have TEAM groups at most, so a meeting
has TEAM * TEAM pairs and a language of G sources G / TEAM rounds.

Defined cases: null text, lang and source count as ''; texts without terms still make their group occur; a language without kept terms has value 0
for all its pairs and no term rows; a source alone in its language has no pairs; repeated rows are documents of their own; an empty table gives
no rows; further columns are ignored. Equal values rank by the item's UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.llm.common import _FOLD, blocks, ready, rows_of, settle, shared_dir, spans, table

UNIT = 1_000_000_000
#: Groups of a team, and entries of a cell, at most (about).
TEAM = 8
CELL = 500_000
#: At most so many buckets, of a cell each up to that. Text bytes that a task counts at once.
BUCKETS = 4096
COUNT_BYTES = 4_000_000

TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True


# --- counting ---


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each value over them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.diff(ordered, prepend=ordered[0] - 1)) if len(ordered) else np.zeros(0, np.int64)
    return (ordered[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs) of each block of texts."""
    for batch, data, limits in blocks(batches, most=COUNT_BYTES, rows=1 << 20):
        inside = TERM[data]
        starts, ends, first = spans(inside, limits)
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(_FOLD[data][inside])]).dictionary_encode()
        code = terms.indices.to_numpy().astype(np.int64)
        group = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        names: dict = {}
        of_row = np.array([names.setdefault((x["lang"], x["source"]), len(names)) for x in group.to_pylist()], np.int64)
        width = max(1, len(terms.dictionary))
        in_doc, n = _sums(rows_of(first) * width + code, np.ones(len(code), np.int64))
        keys, n, docs = _sums(of_row[in_doc // width] * width + in_doc % width, n, np.ones(len(n), np.int64))
        who, langs, sources = keys // width, *(pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
        text = terms.dictionary.take(pa.array(keys % width)).cast(pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(who)), sources.take(pa.array(who)), text, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def kept_terms(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """(lang, source, term, n, lang_n, first): counts of terms in at least least_docs documents of the language; first marks one row of each term."""
    ready(docs.sparkSession)
    parts = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    seen = counts.withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "least": F.min("source").over(of_term)})
    return settle(seen.filter(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("least")).alias("first")), "terms")


# --- exact values ---


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """floor(UNIT * a / b) for 0 <= a <= b < 2**53, by long division."""
    out = np.zeros(np.broadcast(a, b).shape, np.int64)
    left = np.broadcast_to(a, out.shape)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // b
        left = left % b
    return out


def _p(count: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    return 1 + _quotient(np.asarray(count, np.int64) + 1, np.asarray(total, np.int64) + v)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


# --- cells ---

PACKED = "lang string, team int, piece int, cell binary"


def _pack(keys: tuple, entries: pa.Table) -> pa.Table:
    """One cell: its entries (member, term, n, lang_n), sorted by term, compressed."""
    rows = entries.select(["member", "term", "n", "lang_n"]).sort_by([("term", "ascending"), ("member", "ascending")]).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    lang, team, piece = (k.as_py() for k in keys)
    return pa.table({"lang": [lang], "team": pa.array([team], pa.int32()), "piece": pa.array([piece], pa.int32()), "cell": [sink.getvalue().to_pybytes()]})


def _unpack(cell: bytes | None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    if cell is None:
        return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = pa.ipc.open_stream(cell).read_all().combine_chunks()
    member, n, lang_n = (rows.column(c).to_numpy() for c in ("member", "n", "lang_n"))
    return member, rows.column("term").combine_chunks().cast(pa.binary()), n, lang_n


def _matrix(members: list, v: int, member: np.ndarray, place: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """p of each member (rows) and term (columns); terms that a member hasn't have the p of no occurrence."""
    totals = np.array([m["total"] for m in members], np.int64)
    out = np.repeat(_p(np.zeros(len(totals), np.int64), totals, v)[:, None], width, axis=1)
    out[member, place] = _p(n, totals[member], v)
    return out


PAIRS = "lang string, source string, item string, value long, terms long"


def _both(lang: str, a: list, b: list, p: np.ndarray, q: np.ndarray, pairs: Iterator[tuple[int, int]]) -> pa.RecordBatch:
    """Both directions of the pairs of a row of p and a row of q."""
    out = []
    for i, j in pairs:
        d = (p[i] - q[j]) ** 2
        out.append((lang, a[i]["source"], b[j]["source"], int((d // q[j]).sum()), p.shape[1]))
        out.append((lang, b[j]["source"], a[i]["source"], int((d // p[i]).sum()), p.shape[1]))
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["lang", "source", "item", "value", "terms"])


def _at_home(top: int):
    """Each cell alone: pairs within the team (terms > 0), and each member's best terms (terms = -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            members, v = row["members"], row["v"]
            member, term, n, lang_n = _unpack(row["cell"])
            names = term.dictionary_encode()
            place, width = names.indices.to_numpy(), len(names.dictionary)
            p = _matrix(members, v, member, place, n, width)
            yield _both(row["lang"], members, members, p, p, ((i, j) for i in range(len(members)) for j in range(i)))
            if not len(n):
                continue
            own, of_lang = p[member, place], _p(lang_n, np.full(len(n), row["lang_total"], np.int64), v)
            value = np.where(own > of_lang, _f(own, of_lang), -1)
            out = []
            for m in range(len(members)):
                mine = np.flatnonzero((member == m) & (value >= 0))
                if len(mine) > top:  # a heap of what can be among the best; ties at the edge all go in
                    mine = mine[value[mine] >= np.partition(value[mine], len(mine) - top)[len(mine) - top]]
                best = heapq.nsmallest(top, zip((-value[mine]).tolist(), term.take(pa.array(mine)).to_pylist(), strict=True))
                out += [(row["lang"], members[m]["source"], t.decode(), -x, -1) for x, t in best]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["lang", "source", "item", "value", "terms"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A host's cell and a visitor's: all pairs of a host's group and a visitor's, both ways."""
    for row in (r for b in batches for r in b.to_pylist()):
        (m1, t1, n1, _), (m2, t2, n2, _) = _unpack(row["cell"]), _unpack(row["visiting_cell"])
        names = pa.chunked_array([t1, t2]).combine_chunks().dictionary_encode()
        place, width = names.indices.to_numpy(), len(names.dictionary)
        p = _matrix(row["members"], row["v"], m1, place[: len(n1)], n1, width)
        q = _matrix(row["visitors"], row["v"], m2, place[len(n1) :], n2, width)
        yield _both(row["lang"], row["members"], row["visitors"], p, q, ((i, j) for i in range(len(p)) for j in range(len(q))))


def circle(teams: int, round_: int) -> list[tuple[int, int]]:
    """(host, visitor) of a round of the circle method: team 0 keeps its seat, the others move on by one; in teams - 1 rounds all pairs meet once."""
    seats = [0, *((k + round_) % (teams - 1) + 1 for k in range(teams - 1))]
    return [(seats[k], seats[teams - 1 - k]) for k in range(teams // 2)]


# --- the audit ---


def groups_of(docs: DataFrame, terms: DataFrame, team: int = TEAM) -> DataFrame:
    """(lang, source, total, entries, v, lang_total, team, member): every occurring group, seated by size, so that hot ones sit in teams of their own as far as possible."""
    counted = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("entries"), F.count_if("first").alias("firsts"))
    there = docs.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").fillna(0, ["total", "entries", "firsts"])
    of_lang = W.partitionBy("lang")
    seats = there.withColumns({"v": F.sum("firsts").over(of_lang), "lang_total": F.sum("total").over(of_lang), "g": F.count("*").over(of_lang), "rank": F.row_number().over(of_lang.orderBy(F.desc("total"), "source")) - 1})
    teams = F.ceil(F.col("g") / team)
    return settle(seats.select("lang", "source", "total", "entries", "v", "lang_total", (F.col("rank") % teams).cast("int").alias("team"), F.floor(F.col("rank") / teams).cast("int").alias("member")), "groups")


def audit(docs: DataFrame, top: int = 200, least_docs: int = 3, team: int = TEAM, cell: int = CELL) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` for every other source of the language, part `term` for the top terms of each group."""
    spark = ready(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(empty("lang"), empty("source"), empty("text"))
    terms = kept_terms(docs, least_docs)
    groups = groups_of(docs, terms, team)
    size = groups.groupBy("lang", "team").agg(F.max("v").alias("v"), F.count("*").alias("members")).agg(F.max(F.col("v") * F.col("members")).alias("cells"), F.max("team").alias("team"), F.count("*").alias("all")).first()
    pieces = max(4, -(-(size["cells"] or 0) // cell))
    teams = (size["team"] or 0) + 1
    teams += teams % 2
    buckets = min(BUCKETS, max(8, pieces * size["all"]))

    seat = groups.select("lang", "source", "team", "member")
    piece = F.pmod(F.xxhash64("term"), F.lit(pieces)).cast("int")
    entries = terms.join(seat, ["lang", "source"]).select("lang", "team", piece.alias("piece"), "member", "term", "n", "lang_n")
    packed = entries.groupBy("lang", "team", "piece").applyInArrow(_pack, PACKED)
    rosters = groups.groupBy("lang", "team").agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "source", "total"))), lambda x: F.struct(x.source.alias("source"), x.total.alias("total"))).alias("members"), F.max("v").alias("v"), F.max("lang_total").alias("lang_total"))
    every = rosters.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    slot = lambda team: F.concat_ws(":", F.col("piece").cast("string"), team.cast("string"), "lang")
    cells = every.join(packed, ["lang", "team", "piece"], "left").withColumn("slot", slot(F.col("team")))

    name = f"loomset_cells_{uuid.uuid4().hex}"
    cells.repartition(buckets, "slot").write.bucketBy(buckets, "slot").format("parquet").option("path", f"{shared_dir(spark).rstrip('/')}/loomset/{name}").saveAsTable(name)
    try:
        hosts = spark.table(name)
        rounds = [settle(hosts.mapInArrow(_at_home(top), PAIRS), "home")]
        for r in range(teams - 1):
            fixtures = F.create_map(*[F.lit(int(x)) for pair in circle(teams, r) for x in reversed(pair)])
            away = hosts.withColumn("host", F.try_element_at(fixtures, "team")).filter("host IS NOT NULL")
            visitors = away.select(slot(F.col("host")).alias("slot"), F.col("members").alias("visitors"), F.col("cell").alias("visiting_cell"))
            meetings = hosts.join(visitors.hint("merge"), "slot")
            rounds.append(settle(meetings.select("lang", "v", "members", "cell", "visitors", "visiting_cell").mapInArrow(_meet, PAIRS), "round"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")

    all_ = rounds[0]
    for more in rounds[1:]:
        all_ = all_.unionByName(more)
    return _ranked(all_, groups, top)


def _ranked(found: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = found.filter("terms = -1").select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= top)
    sums = found.filter("terms >= 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    # p of a term that a group hasn't: exact in decimals
    none = lambda total: F.expr(f"1 + cast(1000000000 * 1BD div ({total} + v) as long)")
    one = groups.filter("v > 0").select("lang", "source", "v", none("total").alias("p0"))
    pair = sums.join(one, ["lang", "source"], "left").join(one.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), ["lang", "item"], "left")
    rest = F.expr("(v - terms) * ((p0 - q0) * (p0 - q0) div q0)")
    valued = pair.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("v").isNull(), F.lit(0).cast("long")).otherwise(F.col("value") + rest).alias("value"))
    return valued.withColumn("rank", F.row_number().over(order)).unionByName(best)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
g AS (SELECT a.lang, a.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = a.lang AND c.source = a.source), 0)::HUGEINT AS total, (SELECT count(*) FROM kept k WHERE k.lang = a.lang)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM d) a),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM kept),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
best AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (FROM every UNION ALL FROM best) QUALIFY part = 'pair' OR rank <= 200
"""
