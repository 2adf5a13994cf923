"""Files: images, record texts, trainer formats, checkpoints, configuration."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset import config
from loomset.operators import enrich, lowrank, tensors
from loomset.sources import images, records, ron, safetensors, sinks, tagdict

RON = """(
  manual_tags: ["sea_wall", "-blur",],
  auto_tags: [(tag: "gull", score: 0.5, category: "general")], // the only one
  /* two lines
     of remark */
  caption: Some("the caf\\u{e9} by the pier"),
  captioner: Some((model: "eye-2", captioned_at: "2024-06-30T12:00:00Z")),
  caption_hint: Some("Top: the lighthouse.\\nBelow: two boats."),
  later_field: {"depth": [2, 3]},
)"""


def test_ron_round_trip():
    tree = ron.loads(RON)
    assert tree["caption"] == "the café by the pier" and tree["manual_tags"] == ["sea_wall", "-blur"] and tree["later_field"] == {"depth": [2, 3]}
    value = {"a": ["x\n\"y\"", 1, 2.5, True], "m": ron.Map({"k": {"z": "\u0001"}}), "n": ron.Some({"q": []})}
    assert ron.loads(ron.dumps(value)) == {"a": ["x\n\"y\"", 1, 2.5, True], "m": {"k": {"z": "\u0001"}}, "n": {"q": []}}
    for bad in ("(a: 1", "[1 2]", "(a 1)", "x y"):
        with pytest.raises(ValueError):
            ron.loads(bad)


def test_records_and_images(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.png", "a.JPG", "sub/b c.webp", "note.txt"):
        (tmp_path / name).write_bytes(b"x" * 3)
    (tmp_path / "a.ron").write_text(RON)
    (tmp_path / "sub" / "b c.ron").write_text("(manual_tags: [\"z\"])")
    found = images.scan(spark, str(tmp_path))
    assert sorted(os.path.basename(r["image_path"]) for r in found.collect()) == ["a.JPG", "a.png", "b c.webp"]
    held = records.read(spark, str(tmp_path))
    both = {os.path.basename(r["image_path"]): r for r in images.with_records(found, held, "inner").collect()}
    assert set(both) == {"a.JPG", "a.png", "b c.webp"}
    a = both["a.png"]
    assert a["captions"]["eye-2"]["caption"] == "the café by the pier" and a["caption_hints"] == ["Top: the lighthouse.", "Below: two boats."] and a["auto_tags"][0]["tag"] == "gull"
    # written and read again, records stay the same
    assert records.write(held.withColumn("manual_tags", F.array_append("manual_tags", F.lit("new")))).count() == 2
    again = {r["sidecar_key"]: r for r in records.read(spark, str(tmp_path)).collect()}
    assert again[str(tmp_path / "a")]["manual_tags"] == ["sea_wall", "-blur", "new"] and again[str(tmp_path / "a")]["captions"]["eye-2"]["caption"] == "the café by the pier"
    (tmp_path / "bad.ron").write_text("(oops")
    assert {os.path.basename(r["sidecar_key"]) for r in records.read(spark, str(tmp_path), strict=False).filter("error IS NOT NULL").collect()} == {"bad"}
    with pytest.raises(Exception, match="bad"):
        records.read(spark, str(tmp_path)).collect()


def test_trainer_formats_and_moves(spark, tmp_path):
    for name in ("a.png", "b.png"):
        (tmp_path / name).write_text("i")
    (tmp_path / "a.ron").write_text("()")
    pairs = spark.createDataFrame([(str(tmp_path / "b.png"), "t, u", None), (str(tmp_path / "a.png"), None, "c \"q\""), ("/none.png", None, None)], "image_path string, tags string, caption string")
    sinks.write_sd_scripts(pairs, str(tmp_path / "meta.json"))
    assert json.loads((tmp_path / "meta.json").read_text()) == {str(tmp_path / "a.png"): {"caption": "c \"q\""}, str(tmp_path / "b.png"): {"tags": "t, u"}}
    sinks.write_musubi(pairs, str(tmp_path / "meta.jsonl"))
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "meta.jsonl")).collect()] == [{"caption": "c \"q\"", "image_path": str(tmp_path / "a.png")}]
    assert sinks.write_texts(pairs.filter("tags IS NOT NULL").select("image_path", F.col("tags").alias("text"))).count() == 1
    assert (tmp_path / "b.txt").read_text() == "t, u"
    plan = spark.createDataFrame([(str(tmp_path / "a.png"), str(tmp_path / "d/a.png"), True, "move"), (str(tmp_path / "b.png"), "x", False, "skip")], "src string, dst string, has_record boolean, action string")
    assert sinks.run_moves(plan, dry_run=True).count() == 1 and (tmp_path / "a.png").exists()
    assert sinks.run_moves(plan).count() == 1
    assert (tmp_path / "d/a.png").exists() and (tmp_path / "d/a.ron").exists() and (tmp_path / "b.png").exists()
    found = images.scan(spark, str(tmp_path))
    assert sinks.delete_images(found, spark.createDataFrame([(str(tmp_path / "d/a.png"),)], "image_path string")).count() == 1
    assert not (tmp_path / "d/a.ron").exists()


def test_one_json_file_of_many_parts(spark, tmp_path):
    rows = [(f"/a/{i * 7919 % 500:03d} \"q\".png", f"t{i}" if i % 3 else None, "é" * (i % 9) if i % 4 else None) for i in range(500)]
    pairs = spark.createDataFrame(rows, "image_path string, tags string, caption string").repartition(7)
    sinks.write_sd_scripts(pairs, str(tmp_path / "meta.json"))
    kept = sorted(r for r in rows if r[1] is not None or r[2] is not None)
    show = lambda x: json.dumps(x, ensure_ascii=False)
    entry = lambda tags, caption: "{" + ",".join(f'"{k}":{show(v)}' for k, v in (("caption", caption), ("tags", tags)) if v is not None) + "}"
    want = "{" + ",".join(f"\n  {show(p)}: {entry(t, c)}" for p, t, c in kept) + "\n}\n"
    assert (tmp_path / "meta.json").read_text() == want
    sinks.write_sd_scripts(pairs.limit(0), str(tmp_path / "meta.json"))
    assert (tmp_path / "meta.json").read_text() == "{\n}\n" and os.listdir(tmp_path) == ["meta.json"]


def test_tag_dictionary(spark, tmp_path):
    (tmp_path / "tags.csv").write_text("tag_id,name,category,count\n9,1girl,0,5\n8,hatsune,4,2\n7,odd,6,1\n")
    got = tagdict.load(spark, str(tmp_path / "tags.csv"))
    assert [r["category_name"] for r in got.orderBy("tag_id").collect()] == ["category_6", "character", "general"]
    numbered = got.withColumn("idx", F.expr("CASE tag_id WHEN 9 THEN 0 WHEN 8 THEN 1 ELSE 2 END"))
    scores = spark.createDataFrame([("k", [0.5, 0.5, 0.05])], "sidecar_key string, scores array<float>")
    assert [t["tag"] for t in tagdict.tagged(numbered, scores).first()["auto_tags"]] == ["1girl", "hatsune"]


def test_checkpoint_round_trip_and_merge(spark, tmp_path):
    def file(name, prefix, fill, dtype="F32"):
        rows = [(f"{prefix}w", dtype, [3, 2], 0, (fill * np.arange(6, dtype="f4")).tolist()), (f"{prefix}extra", "F16", [3], 1, [1.0, -2.5, 65504.0])]
        df = spark.createDataFrame(rows, "key string, dtype string, shape array<bigint>, ord bigint, values array<float>")
        safetensors.write(safetensors.encoded(df, F.col("dtype")), str(tmp_path / name), {"made": "here"})
        return safetensors.decoded(safetensors.read(spark, str(tmp_path / name)))

    base, tuned, target = file("b", "net.", 0.5), file("t", "model.diffusion_model.", 2.0), file("x", "diffusion_model.", -3.0, "BF16")
    assert safetensors.metadata(str(tmp_path / "b")) == {"made": "here"}
    assert os.path.getsize(tmp_path / "b") % 2 == 0
    got = {r["key"]: r for r in tensors.merge_diff(base, tuned, target).collect()}
    assert got["diffusion_model.w"]["values"] == [-1.5 * i for i in range(6)] and got["diffusion_model.w"]["applied"]
    same = {r["key"]: r["values"] for r in tensors.merge_diff(base, tuned, target, multiplier=0.0).collect()}
    assert same["diffusion_model.w"] == [-3.0 * i for i in range(6)]
    assert same["diffusion_model.extra"] == [1.0, -2.5, 65504.0]
    with pytest.raises(ValueError):
        tensors.refuse_scaled(spark.createDataFrame([("a.weight_scale",)], "key string"))
    (tmp_path / "bad").write_bytes(b"\xff" * 16)
    with pytest.raises(ValueError):
        safetensors.header(str(tmp_path / "bad"))


def test_bf16_rounds_to_even():
    v = np.array([1.0, 1.00390625, 1.01171875, -3.14159, np.inf, 0.0], "f4")
    back = safetensors.decode(safetensors.encode(v, "BF16"), "BF16")
    assert back.tolist() == [1.0, 1.0, 1.015625, -3.140625, np.inf, 0.0]
    assert np.isnan(safetensors.decode(safetensors.encode(np.array([np.nan], "f4"), "BF16"), "BF16")[0])


def test_low_rank_delta_is_recovered(spark):
    # a delta of rank 5 with known singular values, from orthonormal bases
    rng = np.random.default_rng(2024)
    u, v = (np.linalg.qr(rng.standard_normal((n, 5)))[0] for n in (72, 40))
    d = (u * np.array([3.0, 1.5, 0.8, 0.4, 0.2])) @ v.T
    side = lambda x: spark.createDataFrame([("net.m.weight", "F32", [72, 40], x.astype("f4").ravel().tolist()), ("net.zero.weight", "F32", [8, 8], [0.5] * 64)], "key string, dtype string, shape array<bigint>, values array<float>")
    rows = tensors.lora_rows(tensors.lora_modules(side(np.zeros((72, 40))), side(d)))
    basis, made = lowrank.adapter(rows, rank=5, alpha=10.0)
    got = {r["module"]: r for r in basis.collect()}
    up, down = (np.array([r["values"] for r in made.filter(F.col("key") == f"lora_unet_m.lora_{x}.weight").orderBy("row").collect()]) for x in ("up", "down"))
    assert abs(got["lora_unet_m"]["energy"] - 1) < 1e-4 and np.abs(up @ down * (10.0 / 5) - d).max() < 1e-5
    two = {r["module"]: r for r in lowrank.low_rank_basis(rows, rank=2).collect()}["lora_unet_m"]
    assert abs(two["energy"] - (9 + 2.25) / (9 + 2.25 + 0.64 + 0.16 + 0.04)) < 1e-4
    assert got["lora_unet_zero"]["energy"] == 1.0
    h = np.array(tensors.hadamard(64)) / 8
    assert np.allclose(h @ h, np.eye(64)) and np.allclose(h, h.T)


def test_configuration(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "user"))
    (tmp_path / "user/loomset").mkdir(parents=True)
    (tmp_path / "user/loomset/config.toml").write_text('default_profile = "plain"\n[export.anima]\nthreshold = 0.5\n[tag_group.a]\ntags = []\n')
    (tmp_path / "p/q").mkdir(parents=True)
    (tmp_path / "p/loomset.toml").write_text('[tag_group.a]\ntags = ["x", "y"]\n[captioner_prompts]\ncharacter = "Who?"\n[captioner.c]\nkind = "openai"\nendpoint = "http://h"\nmodel = "m"\n')
    c = config.load(tmp_path / "p/q")
    assert c.profile("anima").threshold == 0.5 and c.profile("anima").category_prefixes == {} and c.profile("nope") == config.ExportProfile()
    assert c.group("a") == ["x", "y"] and c.default_profile == "plain"
    assert [n for n, _ in c.prompts(("character", "default", "character"))] == ["character", "default"]
    assert c.resolve_captioner("c")[1].endpoint == "http://h" and c.resolve_tagger()[0] == "built-in" and c.resolve_upscaler()[1].max_edge == 2048
    with pytest.raises(KeyError):
        c.prompts(("zzz",))
    with pytest.raises(KeyError):
        c.group("zzz")
    import tomllib

    assert config.Config().overlaid(tomllib.loads(config.to_toml(c))) == c
    (tmp_path / "p/loomset.toml").write_text("")
    with pytest.raises(ValueError):
        config.load(tmp_path / "p/q")


def test_enrichment(spark):
    df = spark.createDataFrame([("a",), ("bad",)], "sidecar_key string")

    def factory():
        tries = {}

        def model(row):
            tries[row["sidecar_key"]] = tries.get(row["sidecar_key"], 0) + 1
            if row["sidecar_key"] == "bad":
                raise ValueError("no")
            if tries[row["sidecar_key"]] < 3:
                raise ConnectionError("down")
            return {"sidecar_key": row["sidecar_key"], "text": "ok"}

        return model

    got = {r["sidecar_key"]: r for r in enrich.apply(df, factory, "sidecar_key string, text string", keep_going=True, retries=3).collect()}
    assert got["a"]["text"] == "ok" and got["bad"]["error"] == "no"
    with pytest.raises(Exception, match="no"):
        enrich.apply(df, factory, "sidecar_key string, text string", retries=3).collect()
    text = '{"1": {"class_type": "LoadImage", "inputs": {}}, "2": {"class_type": "SaveImage"}}'
    assert enrich.check_workflow(text) == ("1", "2")
    one = spark.range(1).select(enrich.filled_workflow(text, F.lit('x "y".png')).alias("w"), enrich.chat_request(F.lit('m"1'), F.lit("say"), F.lit("data:x"), F.lit(5)).alias("r")).first()
    assert json.loads(one["w"])["1"]["inputs"]["image"] == 'x "y".png'
    body = json.loads(one["r"])
    assert body["model"] == 'm"1' and body["messages"][0]["content"][1]["text"] == "say" and body["max_tokens"] == 5
    for bad in ('[]', '{"nodes": []}', '{"1": {"class_type": "SaveImage"}}', '{"1": {"class_type": "LoadImage"}}'):
        with pytest.raises(ValueError):
            enrich.check_workflow(bad)
