"""Line deduplication against a brute-force version in plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.llm import line_dedup
from loomset.llm.common import hashes, mix


def _line_hash(line: str) -> int:
    data = np.frombuffer(line.encode(), np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]), fold=False)[0])


def _chunks(text: str, least: int = line_dedup.LONG) -> list[tuple[int, int]]:
    lines, out, first = text.split("\n"), [], 0
    long = [len(x.split()) >= least for x in lines]
    for i in range(len(lines)):
        rolled = int(mix(np.array([(_line_hash(lines[i - 1]) * 0x9E3779B97F4A7C15 + _line_hash(lines[i])) % 2**64], np.uint64), 6)[0]) if i else None
        if i == len(lines) - 1 or long[i] or long[i + 1] or (rolled is not None and rolled % line_dedup.EVERY == 0):
            out.append((first, i))
            first = i + 1
    return out


def _windows(lines: list[str], long: int) -> list[tuple[int, int]]:
    """From every line on and up to every line, the fewest lines, but several, that have `long` words."""
    n, out = [len(x.split()) for x in lines], set()
    for i in range(len(lines)):
        out |= {(i, b) for b in range(i, len(lines)) if sum(n[i : b + 1]) >= long > sum(n[i:b])}
        out |= {(a, i) for a in range(i + 1) if sum(n[a : i + 1]) >= long > sum(n[a + 1 : i + 1])}
    return sorted((a, b) for a, b in out if a < b)


def brute_passages(rows: list[tuple[int, str]], long: int, few: int) -> dict[int, str]:
    """Of each chunk and of each window, apart, the first by doc_id and place stays; one that overlaps it in its text loses the lines beyond it."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        lines, gone = (text or "").split("\n"), set()
        n = [len(x.split()) for x in lines]
        parts = [("chunk", a, b) for a, b in (_chunks(text, long) if text else []) if sum(n[a : b + 1]) >= (few if b > a else long)]
        for kind, a, b in parts + [("window", a, b) for a, b in _windows(lines, long)]:
            at = seen.setdefault((kind, *lines[a : b + 1]), (doc_id, a))
            if at != (doc_id, a):
                gone |= set(range(max(a, at[1] + b - a + 1) if at[0] == doc_id else a, b + 1))
        out[doc_id] = text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def brute(rows: list[tuple[int, str]]) -> dict[int, str]:
    """First by doc_id and place stays."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        if not text:
            out[doc_id] = text
            continue
        lines, gone = text.split("\n"), set()
        for a, b in _chunks(text):
            chunk, n = "\n".join(lines[a : b + 1]), sum(len(x.split()) for x in lines[a : b + 1])
            if n >= line_dedup.LONG or (b > a and n >= line_dedup.WORDS):
                if seen.setdefault(chunk, (doc_id, a)) != (doc_id, a):
                    gone |= set(range(a, b + 1))
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def _line(rng, n):
    return " ".join(f"w{rng.integers(5000)}" for _ in range(n))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    shared = ["\n".join(_line(rng, 9) for _ in range(14)) for _ in range(4)] + [_line(rng, 60)]
    rows = []
    for i in range(60):
        parts = [_line(rng, int(rng.integers(0, 15))) for _ in range(int(rng.integers(1, 8)))]
        for _ in range(int(rng.integers(0, 3))):
            parts.insert(int(rng.integers(0, len(parts) + 1)), shared[int(rng.integers(len(shared)))])
        rows.append((i, "\n".join(parts)))
    rows += [(100, ""), (101, None), (102, rows[0][1]), (103, "\n"), (104, "\n\n" + rows[1][1] + "\n")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute(rows)
    assert {k: r["text"] for k, r in got.items()} == want
    assert sum(r["n_removed"] > 0 for r in got.values()) > 20


def test_empty_table_repeated_rows_and_clashing_columns(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "x"), (1, text, "y"), (2, text, "z"), (None, text, "n")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_removed string").withColumn("hash", F.lit("h")).withColumn("gone", F.lit("g")).withColumn("row", F.lit("r"))).collect()
    assert sorted((r["doc_id"] or 99, r["text"]) for r in got) == [(1, text), (1, text), (2, ""), (99, "")]


def test_passage_is_removed_but_first_stays(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, f"own {i} line\n{passage}\nlast {i}") for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in got[0]
    assert all(got[i] == f"own {i} line\nlast {i}" for i in range(1, 5))


def _passages_left(rows: list[tuple[int, str]], got: dict[int, str]) -> None:
    """Each line that lies in a run of LONG words which stood earlier is gone, unless the earlier run overlaps it; some copy of every line stays."""
    seen = {}
    for doc_id, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        n = [len(x.split()) for x in lines]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines)):
                if sum(n[a : b + 1]) >= line_dedup.LONG:
                    at = seen.setdefault(tuple(lines[a : b + 1]), (doc_id, a))
                    if at != (doc_id, a):
                        gone |= set(range(max(a, at[1] + b - a + 1) if at[0] == doc_id else a, b + 1))
        left = got[doc_id].split("\n")
        want = [x for i, x in enumerate(lines) if i not in gone]
        rest = iter(want)
        assert all(x in rest for x in left if x), doc_id  # nothing but what may stay
    assert {x for _, t in rows for x in t.split("\n") if x} == {x for t in got.values() for x in t.split("\n") if x}


def test_multi_line_passages_between_unlike_lines_go_whole(spark):
    rng = np.random.default_rng(11)
    rows, passages = [], []
    for k, (n, m) in enumerate([(6, 10), (4, 15), (3, 20), (10, 10), (5, 10), (2, 25)] * 3):
        passage = "\n".join(_line(rng, m) for _ in range(n))
        passages.append(passage)
        for i in range(3):
            rows.append((10 * k + i, "\n".join([_line(rng, 7), _line(rng, 12), passage, _line(rng, 9), _line(rng, 8)])))
    same = _line(rng, 10)
    rows.append((5000, "\n".join([same] * 20)))
    rows.append((5001, passages[0] + "\n" + passages[1] + "\n" + _line(rng, 5)))
    rows.append((5002, "\n".join(passages[2].split("\n")[:2] + [_line(rng, 6)])))  # 40 words of a passage are no passage
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), passages=True).collect()}
    for k, passage in enumerate(passages):
        assert got[10 * k]["n_removed"] == 0
        for i in (1, 2):
            own = dict(rows)[10 * k + i].split("\n")
            assert got[10 * k + i]["text"].split("\n") == own[:2] + own[-2:]
    assert got[5000]["text"] == "\n".join([same] * 5)
    assert got[5001]["text"] == rows[-2][1].split("\n")[-1]
    _passages_left(rows, {i: r["text"] for i, r in got.items()})
    want = brute_passages(rows, line_dedup.LONG, line_dedup.WORDS)
    assert {i: r["text"] for i, r in got.items()} == want
    assert got[5002]["text"] == dict(rows)[5002]  # its runs of the passage's lines bound no chunk


@pytest.mark.parametrize("long,few", [(50, 20), (20, 20), (12, 7)])
def test_whole_result_with_passages_equals_brute_force(spark, long, few):
    rng = np.random.default_rng(long)
    shared = ["\n".join(_line(rng, int(rng.integers(2, 12))) for _ in range(int(rng.integers(2, 9)))) for _ in range(6)] + [_line(rng, 60), _line(rng, 15)]
    rows = []
    for i in range(80):
        parts = [_line(rng, int(rng.integers(0, 15))) for _ in range(int(rng.integers(1, 6)))]
        for _ in range(int(rng.integers(0, 4))):
            parts.insert(int(rng.integers(0, len(parts) + 1)), shared[int(rng.integers(len(shared)))])
        rows.append((i, "\n".join(parts)))
    rows += [(100, ""), (101, None), (102, rows[0][1]), (103, "\n"), (104, "\n".join(["again and again"] * 30)), (105, shared[0] + "\n" + shared[0])]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), passages=True, long=long, few=few).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute_passages(rows, long, few)
    assert sum(r["n_removed"] > 0 for r in got) > 20
