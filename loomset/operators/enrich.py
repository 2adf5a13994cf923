"""Enrichment by outside models: taggers, captioners, upscalers as pluggable callables over partitions, and the parsing of servers' answers.

A factory is called once in each task, where it opens its session; results are upserted into records like any other table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply(images: DataFrame, factory: Callable[[], Callable[[dict], dict]], schema: str, keep_going: bool = False, retries: int = 0, wait: Callable[[int], None] | None = None) -> DataFrame:
    """images' rows through the callable that factory makes, one result row each (columns of schema and error).

    Errors stop the job, or with keep_going stand in `error`. ConnectionError (servers that fail or can't be reached) is tried again `retries` times, with `wait` called before each.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                for attempt in range(retries + 1):
                    try:
                        out.append({**model(row), "error": None})
                        break
                    except Exception as e:  # noqa: BLE001  reported, or raised
                        if isinstance(e, ConnectionError) and attempt < retries:
                            if wait:
                                wait(attempt + 1)
                            continue
                        if not keep_going:
                            raise
                        out.append({**{n: row.get(n) for n in names}, "error": str(e)})
                        break
            yield pd.DataFrame(out, columns=[*names, "error"])

    return images.mapInPandas(run, f"{schema}, error string")


def onnx_scores(path: str, input_size: int = 448, decode: Callable[[bytes, int], object] | None = None) -> Callable[[], Callable[[dict], dict]]:
    """A tagger: rows (sidecar_key, content) to (sidecar_key, scores). decode turns bytes into the model's input; no image library is bundled."""

    def factory() -> Callable[[dict], dict]:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda row: {"sidecar_key": row["sidecar_key"], "scores": session.run(None, {name: decode(row["content"], input_size)})[0][0].tolist()}

    return factory


def chat_request(model: Column, prompt: Column, image_url: Column, max_tokens: Column) -> Column:
    """The body of a chat completion with an image, as JSON."""
    part = lambda **x: F.struct(*[v.alias(k) for k, v in x.items()])
    content = F.concat(F.lit("["), F.to_json(part(type=F.lit("image_url"), image_url=part(url=image_url))), F.lit(","), F.to_json(part(type=F.lit("text"), text=prompt)), F.lit("]"))
    return F.concat(F.lit('{"model":'), F.regexp_replace(F.to_json(part(m=model)), r'^\{"m":|\}$', ""), F.lit(',"max_tokens":'), max_tokens.cast("string"), F.lit(',"stream":false,"messages":[{"role":"user","content":'), content, F.lit("}]}"))


def chat_answer(body: Column) -> Column:
    return F.trim(F.get_json_object(body, "$.choices[0].message.content"))


def combo_choices(spec: Column) -> Column:
    """Choices of a server's input: [[...], {}] or ["COMBO", {"options": [...]}] or with "values"; sorted without regard to case."""
    strings = lambda path: F.from_json(F.get_json_object(spec, path), "array<string>")
    listed = F.coalesce(F.when(F.startswith(F.get_json_object(spec, "$[0]"), F.lit("[")), strings("$[0]")), strings("$[1].options"), strings("$[1].values"))
    return F.array_sort(listed, lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0))


_IMAGES = "map<string,struct<images:array<struct<filename:string,subfolder:string,type:string>>>>"


def chosen_output(entry: Column, save_node: str) -> Column:
    """Of a job's history entry: the image of the node that saves, or else of the first with images; the first that isn't temporary, or else the first."""
    nodes = F.from_json(F.get_json_object(entry, "$.outputs"), _IMAGES)
    own = F.try_element_at(nodes, F.lit(save_node))["images"]
    images = F.coalesce(own, F.try_element_at(F.filter(F.transform(F.map_values(nodes), lambda n: n.images), lambda i: i.isNotNull()), F.lit(1)))
    kept = F.filter(images, lambda i: F.coalesce(i.type, F.lit("")) != "temp")
    picked = F.coalesce(F.try_element_at(kept, F.lit(1)), F.try_element_at(images, F.lit(1)))
    return F.when(picked["filename"].isNotNull(), F.struct(picked["filename"].alias("filename"), F.coalesce(picked["subfolder"], F.lit("")).alias("subfolder"), F.coalesce(picked["type"], F.lit("output")).alias("kind")))


def check_workflow(text: str) -> tuple[str, str]:
    """(load node, save node) of a job template; refuses what can't be run."""
    graph = json.loads(text)
    if not isinstance(graph, dict):
        raise ValueError("the template is not an object of nodes; export it in API format")
    if isinstance(graph.get("nodes"), list):
        raise ValueError("the template is in UI format; export it in API format")
    of = lambda kind: [k for k, n in graph.items() if isinstance(n, dict) and n.get("class_type") == kind]
    loads, saves = of("LoadImage"), of("SaveImage")
    if len(loads) != 1:
        raise ValueError(f"the template needs one LoadImage node and has {len(loads)}")
    if not saves:
        raise ValueError("the template has no SaveImage node")
    return loads[0], saves[0]


def filled_workflow(text: str, image: Column) -> Column:
    """The template with the image's name in its load node, as JSON for each row."""
    load, _ = check_workflow(text)
    graph = json.loads(text)
    mark = "\u0000image\u0000"
    graph[load].setdefault("inputs", {})["image"] = mark
    head, tail = json.dumps(graph).split(json.dumps(mark))
    name = F.to_json(F.struct(image.alias("i")))
    return F.concat(F.lit(head), F.substring(name, 6, F.length(name) - 6), F.lit(tail))
