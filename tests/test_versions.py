"""Record versions, incremental loads, postings, and journaled file actions."""

import os

import pytest
from pyspark.sql import functions as F

from loomset.operators import filters, postings, versions
from loomset.schema import SIDECAR
from loomset.sources import incremental, journal, records


def _folder(tmp_path, n=6):
    (tmp_path / "set/sub dir").mkdir(parents=True)
    for i in range(n):
        (tmp_path / "set" / ("sub dir" if i % 2 else ".") / f"r{i}.ron").write_text(f'(manual_tags: ["t{i}", "shared"], manual_caption: Some("c{i}"))')
    return tmp_path / "set"


def _changes(df):
    return sorted((os.path.basename(r["path"]), r["change"]) for r in df.collect())


def test_a_second_load_parses_only_what_changed(spark, tmp_path, monkeypatch):
    folder, state = _folder(tmp_path), str(tmp_path / "state")
    parsed, parse = [], records.parsed

    def counted(keyed, strict=True):
        parsed.append(keyed.count())
        return parse(keyed, strict)

    monkeypatch.setattr(records, "parsed", counted)
    held, changes = incremental.load(spark, str(folder), state)
    assert held.count() == 6 and {c for _, c in _changes(changes)} == {"added"} and parsed == [6]
    first = {r["sidecar_key"]: r["digest"] for r in held.collect()}
    held, changes = incremental.load(spark, str(folder), state)
    assert held.count() == 6 and _changes(changes) == [] and parsed == [6, 0]
    (folder / "r0.ron").write_text('(manual_tags: ["new"])')
    os.utime(folder / "r2.ron", (1, 1))
    os.remove(folder / "sub dir/r3.ron")
    (folder / "r9.ron").write_text("()")
    held, changes = incremental.load(spark, str(folder), state)
    assert _changes(changes) == [("r0.ron", "changed"), ("r2.ron", "touched"), ("r3.ron", "deleted"), ("r9.ron", "added")] and parsed == [6, 0, 2]
    now = {os.path.basename(r["sidecar_key"]): r for r in held.collect()}
    assert set(now) == {"r0", "r1", "r2", "r4", "r5", "r9"} and now["r0"]["manual_tags"] == ["new"] and now["r1"]["manual_caption"] == "c1"
    assert now["r1"]["digest"] == first[str(folder / "sub dir/r1")] and now["r0"]["digest"] != first[str(folder / "r0")]
    assert incremental.load(spark, str(folder), state)[0].count() == 6 and parsed[-1] == 0
    (folder / "bad.ron").write_text("(oops")
    with pytest.raises(Exception, match="bad"):
        incremental.load(spark, str(folder), state)
    assert incremental.load(spark, str(folder), state, strict=False)[0].filter("error IS NOT NULL").count() == 1


def test_of_two_clashing_edits_one_comes_back(spark, tmp_path):
    folder, state = _folder(tmp_path, 4), str(tmp_path / "state")
    held = incremental.load(spark, str(folder), state)[0]
    keys = {os.path.basename(r["sidecar_key"]): r for r in held.collect()}
    row = lambda batch, name, seq, op, value, expected=None: (batch, keys[name]["sidecar_key"], expected or keys[name]["digest"], seq, op, value)
    log = [row(1, "r0", 1, "add", "one"), row(1, "r0", 2, "remove", "SHARED"), row(2, "r0", 1, "add", "two"), row(2, "r1", 1, "caption", " fresh "), row(2, "r1", 2, "suppress", "x"), row(3, "r2", 1, "add", "late", "otherdigest"), row(4, "r3", 1, "explode", "x"), (5, str(folder / "none"), "", 1, "add", "x")]
    edited, conflicts = versions.apply(held, spark.createDataFrame(log, versions.LOG))
    lost = sorted((r["batch"], os.path.basename(r["sidecar_key"]), r["reason"]) for r in conflicts.collect())
    assert lost == [(2, "r0", "overtaken"), (3, "r2", "changed"), (4, "r3", "unknown op"), (5, "none", "missing")]
    edited = edited.cache()
    assert edited.count() == 2
    # a foreign writer changes r1 between the plan and the write
    path = keys["r1"]["sidecar_key"] + ".ron"
    with open(path, "a") as f:
        f.write(" // seen to")
    done = {os.path.basename(r["sidecar_key"]): r["outcome"] for r in records.write_if_unchanged(edited).collect()}
    assert done == {"r0": "written", "r1": "conflict"} and open(path).read().endswith("seen to")
    # the same write again, as a task that lost its executor does, finds its own text
    assert {r["outcome"] for r in records.write_if_unchanged(edited.filter(F.endswith("sidecar_key", F.lit("r0")))).collect()} == {"written"}
    again = {os.path.basename(r["sidecar_key"]): r for r in incremental.load(spark, str(folder), state)[0].collect()}
    assert again["r0"]["manual_tags"] == ["t0", "one"] and again["r1"]["manual_tags"] == ["t1", "shared"]
    # what came back applies to the version of now
    retry = spark.createDataFrame([(6, again["r0"]["sidecar_key"], again["r0"]["digest"], 1, "add", "two")], versions.LOG)
    edited, conflicts = versions.apply(incremental.load(spark, str(folder), state)[0], retry)
    assert conflicts.count() == 0 and edited.first()["manual_tags"] == ["t0", "one", "two"]


TAGS = [["sea wall", "-blur"], ["Ab", "abc", "ABCD"], [], ["日本語", "本語"], ["100%"], ["a_b", "x.y*"], ["blur"], ["aaaa"]]


def _tagged(spark, lists):
    return spark.createDataFrame([(f"k{i}", t, [(x + "z", 0.5, "general") for x in t[:1]], [], {}, None, [], None, None) for i, t in lists], SIDECAR)


def test_postings_equal_the_scan(spark, tmp_path):
    index = postings.Postings(spark, str(tmp_path / "p"))
    lists = dict(enumerate(TAGS))

    def check():
        now = _tagged(spark, lists.items())
        for needle in ("blur", "-BLUR", " b ", "abc", "bcd", "日本", "日本語z", "", "aaa", "zzzz", "%", "x.y", "wall", "abcabc"):
            want = {r["sidecar_key"] for r in now.filter(filters.search(needle)).collect()}
            assert {r["sidecar_key"] for r in index.search(needle).collect()} == want, needle
        want = {r["sidecar_key"] for r in now.filter(filters.search("sea") & filters.search("blu")).collect()}
        assert {r["sidecar_key"] for r in index.search("sea", "blu").collect()} == want

    index.update(_tagged(spark, lists.items()))
    check()
    lists[1], lists[8] = ["nothing"], ["sea blue", "abc"]
    del lists[6]
    index.update(_tagged(spark, [(i, lists[i]) for i in (1, 8)]), spark.createDataFrame([("k6",)], "sidecar_key string"))
    check()
    assert index.tables.read("tags").filter("tag = 'abcd'").count() == 0 and index.tables.read("grams").filter("tag = 'blurz'").count() == 0


def _tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names}


def test_a_run_that_stopped_is_replayed(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(8):
        (src / f"i{i}.png").write_bytes(b"image" * i)
        (src / f"i{i}.ron").write_text(f"({i})")
    (src / "shared.jpg").write_bytes(b"j")
    moves = spark.createDataFrame([(str(src / f"i{i}.png"), str(tmp_path / f"dst/d{i % 2}/i{i}.png"), True, "move" if i < 4 else "copy") for i in range(8)], "src string, dst string, has_record boolean, action string")
    gone = spark.createDataFrame([(str(src / "shared.jpg"), None, "delete")], "src string, dst string, action string")
    manifest = str(tmp_path / "manifest")
    planned = journal.plan(journal.with_records(moves).unionByName(gone), manifest)
    assert planned.count() == 17 and planned.filter("digest IS NULL").count() == 0
    with pytest.raises(Exception, match="exist"):
        journal.plan(gone, manifest)

    def stops(src, dst, action, digest):
        n = len([f for _, _, names in os.walk(tmp_path / "dst") for f in names])
        if n == 7:  # the copy is there, under its temporary name; the source stays
            with open(f"{dst or src}.part", "wb") as f:
                f.write(b"ha")
            raise RuntimeError("power cut")
        return journal._act(src, dst, action, digest)

    with pytest.raises(Exception, match="power cut"):
        journal.replay(spark, manifest, stops)
    assert len(_tree(tmp_path / "dst")) in (7, 8)
    outcome = journal.replay(spark, manifest)
    assert outcome.count() == 17 and {r["outcome"] for r in outcome.collect()} == {"done"}
    want = {f"d{i % 2}/i{i}.{e}": (b"image" * i if e == "png" else f"({i})".encode()) for i in range(8) for e in ("png", "ron")}
    left = {k: v for k, v in _tree(tmp_path / "dst").items() if not k.endswith(".part")}
    assert left == want
    assert set(_tree(src)) - {x for x in _tree(src) if x.endswith(".part")} == {f"i{i}.{e}" for i in range(4, 8) for e in ("png", "ron")}
    assert {r["outcome"] for r in journal.replay(spark, manifest).collect()} == {"done"}


def test_changed_files_are_left_alone(spark, tmp_path):
    for name in ("a", "b", "c", "d"):
        (tmp_path / name).write_text(name)
    rows = [(str(tmp_path / "a"), str(tmp_path / "x/a"), "move"), (str(tmp_path / "b"), str(tmp_path / "x/b"), "copy"), (str(tmp_path / "c"), None, "delete"), (str(tmp_path / "d"), str(tmp_path / "x/d"), "move")]
    actions = spark.createDataFrame(rows, "src string, dst string, action string")
    journal.plan(actions, str(tmp_path / "m"))
    (tmp_path / "a").write_text("other")
    (tmp_path / "x").mkdir()
    (tmp_path / "x/b").write_text("mine")
    (tmp_path / "c").write_text("other")
    os.remove(tmp_path / "d")
    got = {os.path.basename(r["src"]): r["outcome"] for r in journal.replay(spark, str(tmp_path / "m")).collect()}
    assert got == {"a": "changed", "b": "conflict", "c": "changed", "d": "lost"}
    assert (tmp_path / "a").read_text() == "other" and (tmp_path / "x/b").read_text() == "mine" and (tmp_path / "c").exists()
    with pytest.raises(ValueError, match="two actions"):
        journal.plan(actions.withColumn("dst", F.lit("same")), str(tmp_path / "n"))


def test_upscaled_images_take_their_records_along(spark, tmp_path):
    for name in ("a.jpg", "b.png", "bad.png"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "a.ron").write_text("(1)")
    rows = [(str(tmp_path / n), str(tmp_path / "out" / (n.split(".")[0] + ".png")), n == "a.jpg", a) for n, a in (("a.jpg", "upscale"), ("b.png", "upscale"), ("bad.png", "upscale"), ("b.png", "skip"))]
    planned = spark.createDataFrame(rows, "src string, dst string, has_record boolean, action string")

    def factory():
        def model(data):
            if data == b"bad.png":
                raise ValueError("no such model")
            return data * 4

        return model

    got = {os.path.basename(r["dst"]): r["outcome"] for r in journal.upscale(planned, factory).collect()}
    assert got == {"a.png": "done", "b.png": "done", "bad.png": "no such model"}
    assert _tree(tmp_path / "out") == {"a.png": b"a.jpg" * 4, "b.png": b"b.png" * 4, "a.ron": b"(1)"}
    os.remove(tmp_path / "out/a.ron")  # stopped between image and record
    got = {os.path.basename(r["dst"]): r["outcome"] for r in journal.upscale(planned, factory).collect()}
    assert got == {"a.png": "present", "b.png": "present", "bad.png": "no such model"} and (tmp_path / "out/a.ron").read_text() == "(1)"
