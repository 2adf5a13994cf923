"""Golden rows: a record in, the exact list or text out; and the traps where rules differ from each other."""

import pytest
from pyspark.sql import functions as F

from loomset.config import ANIMA, ExportProfile
from loomset.operators import captions, edits, filters, groups, stats, tags
from loomset.schema import SIDECAR, or_default

A = lambda tag, score=0.9, category="general": (tag, score, category)


def record(spark, manual=(), auto=(), booru=(), captions=None, manual_caption=None, hints=()):
    row = ("k", list(manual), [tuple(a) for a in auto], [tuple(b) for b in booru], {k: (c, None, s) for k, (c, s) in (captions or {}).items()}, manual_caption, list(hints), None, None)
    return spark.createDataFrame([row], SIDECAR)


# one row for each rule: what manual tags block, prefixes, thresholds, categories, suppression, marks, and first of equal ones
EXPORTS = [
    (["monet", "lily pond"], [A("monet", 0.8, "artist"), A("water", 0.7), A("bridge", 0.6)], [], ANIMA, ["monet", "lily pond", "water", "bridge"]),
    ([], [A("boat"), A("monet", 0.8, "artist")], [("cezanne", "artist")], ANIMA, ["boat", "@monet", "@cezanne"]),
    ([], [A("fog", 0.61), A("haze", 0.59), A("mist", 0.6)], [], ExportProfile(threshold=0.6), ["fog", "mist"]),
    (["scan"], [A("scan", 0.9, "meta"), A("jpeg", 0.9, "meta"), A("river")], [("old", "meta")], ExportProfile(exclude_categories=("meta",)), ["scan", "river"]),
    (["-river", "-old"], [A("river"), A("hill")], [("old", "general"), ("sky", "general")], ExportProfile(), ["hill", "sky"]),
    (["-dusk", "dawn", "_scene"], [], [], ExportProfile(), ["dawn"]),
    (["_river", "hill"], [A("river")], [], ExportProfile(), ["hill", "river"]),
    (["hill", "-hill", "sky"], [A("hill"), A("tree")], [("sky", "general")], ExportProfile(), ["hill", "sky", "tree"]),
    (["@goya"], [A("goya", 0.9, "artist"), A("dog")], [], ANIMA, ["@goya", "dog"]),
    ([], [A("shore", 0.35), A("reef", 0.3499)], [], ExportProfile(), ["shore"]),
    ([], [A("odd", float("nan")), A("even")], [], ExportProfile(), ["odd", "even"]),
    (["  pine\t", " "], [A("Pine"), A("oak")], [], ExportProfile(), ["pine", "oak"]),
    (["-elm"], [A(" elm ")], [("ash", "general")], ExportProfile(), [" elm ", "ash"]),
    ([], [A("fir"), A("FIR")], [("Fir", "general"), ("yew", "meta")], ExportProfile(), ["fir", "yew"]),
]


@pytest.mark.parametrize("manual, auto, booru, profile, want", EXPORTS)
def test_export(spark, manual, auto, booru, profile, want):
    r = record(spark, manual, auto, booru)
    assert tags.build_tags(r, profile).first()["tags"] == want
    assert [x["tag"] for x in tags.exported_long(r, profile).orderBy("ord").collect()] == want


# prefixes before suffixes, organisational tags too, first affixes outermost; captions by model name, on a line each; skipped ones left out
CAPTIONS = [
    (["ink"], {"m": ("two herons over a marsh", False)}, None, {"ink": "ink drawing: "}, {}, "ink drawing: two herons over a marsh"),
    (["_Wood_Cut", "x"], {"m": ("a mill", False)}, None, {"wood_cut": "woodcut of "}, {}, "woodcut of a mill"),
    (["ink"], {}, " ", {"ink": "never alone "}, {"ink": "!"}, None),
    (["k"], {"m": ("a gate", False)}, None, {"k": "<"}, {"k": ">"}, "<a gate>"),
    (["ink"], {"m": ("lake", False)}, None, {"ink": "first ", "_ink": "second "}, {}, "second first lake"),
    ([], {"z9": ("the tower", False), "b1": ("the moat", False), "k4": ("the wall", False)}, None, {}, {}, "the moat\nthe wall\nthe tower"),
    ([], {"p": ("one\n two\r\n\nthree   four", False), "q": ("five\t\tsix", False)}, None, {}, {}, "one two three four\nfive six"),
    ([], {"p": ("cannot say", True), "q": ("a quay at noon", False)}, None, {}, {}, "a quay at noon"),
    (["k"], {"p": ("unused", False)}, "\n by hand,\n  two lines ", {"k": "* "}, {}, "* by hand,\n  two lines"),
    ([], {"p": ("\n", False)}, "\t", {}, {}, None),
    (["-k", "ink"], {"p": ("a kite", False)}, None, {"k": "no "}, {"ink": " end"}, "a kite end"),
]


@pytest.mark.parametrize("manual, own, manual_caption, pre, suf, want", CAPTIONS)
def test_caption(spark, manual, own, manual_caption, pre, suf, want):
    r = record(spark, manual, captions=own, manual_caption=manual_caption)
    p = ExportProfile(caption_prefixes=pre, caption_suffixes=suf)
    assert r.select(captions.build_caption(p, F.col("manual_tags"), F.col("manual_caption"), F.col("captions"))).first()[0] == want


@pytest.mark.parametrize("manual, auto, booru, group, want", [
    (["harbour"], [A("quay", 0.4)], [("pier", "general")], ["pier", "quay", "lock"], ("violation", None, ["pier", "quay"])),
    (["-quay"], [A("quay"), A("lock", 0.9)], [], ["lock", "quay"], ("tag", "lock", None)),
    (["_todo", "other"], [], [], ["_done", "_todo"], ("tag", "_todo", None)),
    ([], [A("dusk", 0.02)], [], ["dawn", " Dusk"], ("tag", " Dusk", None)),
    (["-night", "night", "day "], [], [], ["night"], ("unset", None, None)),
    (["Ink"], [], [], ["ink", "INK", "oil"], ("violation", None, ["ink", "INK"])),
])
def test_classify(spark, manual, auto, booru, group, want):
    c = groups.classify(record(spark, manual, auto, booru), group).first()["classification"]
    assert (c["state"], c["tag"], c["tags"]) == want


@pytest.mark.parametrize("manual, auto, group, target, want", [
    (["boat"], ["rain", "fog"], ["fog", "rain", "sun"], "sun", ["boat", "sun", "-fog", "-rain"]),
    (["sun", "kept"], ["fog"], ["fog", "sun", "hail"], None, ["kept", "-fog", "-sun"]),
    (["-oil", "ink"], ["oil"], ["ink", "oil"], "oil", ["oil", "-ink"]),
    (["Oil"], [], ["oil", "ink"], "ink", ["Oil", "ink", "-oil"]),
    (["ink", "x"], [], ["ink"], "  ", ["ink", "x"]),
])
def test_drop(spark, manual, auto, group, target, want):
    got = groups.apply_drop(record(spark, manual, [A(t) for t in auto]), group, target)
    got_tags = got.first()["manual_tags"]
    assert got_tags == want
    again = groups.apply_drop(got, group, target).first()["manual_tags"]
    assert again == got_tags


def test_edits(spark):
    r = record(spark, ["Short_Hair", "keep", "dup", "DUP"], hints=["a"], captions={"p": ("t", True)})
    one = lambda c: r.select(c).first()[0]
    m = F.col("manual_tags")
    assert one(edits.remove_folded(m, F.lit("short_hair"))) == ["keep", "dup", "DUP"]
    assert one(edits.remove_folded(m, F.lit("dup"))) == ["Short_Hair", "keep"]
    assert one(edits.add(m, F.lit(" keep "))) == ["Short_Hair", "keep", "dup", "DUP"]
    assert one(edits.add(m, F.lit(" "))) == ["Short_Hair", "keep", "dup", "DUP"]
    assert one(edits.suppress(m, F.lit("x")))[-1] == "-x"
    assert one(edits.toggle_suppression(edits.suppress(m, F.lit("x")), F.lit("x"))) == ["Short_Hair", "keep", "dup", "DUP"]
    assert one(edits.manual_caption(F.lit(" \t "))) is None
    assert one(edits.toggle_skip(F.col("captions"), F.lit("p")))["p"]["skip"] is False
    assert one(edits.set_caption(F.col("captions"), F.lit("p"), F.lit("n")))["p"]["skip"] is False
    assert one(captions.hint_prompt(F.array(F.lit(" a "), F.lit(""), F.lit("b")))) == "- a\n- b"
    assert one(captions.hint_prompt(F.array(F.lit(" ")))) is None
    with pytest.raises(ValueError):
        edits.add_tags(r, [" "])


def test_views_and_status(spark):
    r = or_default(spark.createDataFrame([("k",)], "sidecar_key string"))
    got = r.select(*[filters.view(v).alias(v) for v in filters.VIEWS]).first().asDict()
    assert got == {"all": True, "untagged": True, "auto_tagged": False, "no_manual": True, "no_caption": True, "no_hint": True, "no_booru": True}
    line = r.select(stats.flags(F.col("tagger"), F.col("captions"), F.col("booru"), F.col("manual_tags"), F.lit("a.png"))).first()[0]
    assert line == "[   ] manual=0 a.png"


def test_nearest_rank_is_not_interpolated(spark):
    got = stats.nearest_rank(spark.createDataFrame([(1,), (2,), (3,), (4,)], "t long"), "t", {"p50": 0.5}).first()
    assert (got["p50"], got["max"], got["n"]) == (3, 4, 4)
    assert stats.nearest_rank(spark.createDataFrame([], "t long"), "t", {"p50": 0.5}).first()["n"] == 0
