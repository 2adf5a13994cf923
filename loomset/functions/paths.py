"""Paths, names, encodings and small arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image extensions and their media types.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "bmp": "image/bmp"}

#: Key prefixes of each model architecture, longest first where one ends another.
ARCH_PREFIXES = {"auto": ["model.diffusion_model.", "diffusion_model.", "net."], "krea2": ["model.diffusion_model.", "diffusion_model."], "anima": ["net.", "model.diffusion_model.", "diffusion_model."]}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*MIME)


def sidecar_key(path: Column) -> Column:
    """The path less its extension: images that differ in it alone share a record."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def with_extension(path: Column, ext: str) -> Column:
    return F.concat(sidecar_key(path), F.lit(f".{ext}"))


def relative(path: Column, base: str) -> Column:
    base = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def mime(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for k, v in MIME.items():
        out = F.when(extension(path) == k, v).otherwise(out)
    return out


def data_url(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime(path), F.lit(";base64,"), F.base64(content))


def percent_encode(c: Column) -> Column:
    """RFC 3986 with slashes kept; url_encode() writes forms instead."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def join_subdir(prefix: Column, name: Column) -> Column:
    return F.when(prefix == "", name).otherwise(F.concat(prefix, F.lit("/"), name))


def arch_stripped(key: Column, arch: str = "auto") -> Column:
    """A tensor's key without the first prefix of the architecture that it has."""
    arch = {"krea": "krea2"}.get(arch.lower(), arch.lower())
    if arch not in ARCH_PREFIXES:
        raise ValueError(f"no key prefixes are known for the architecture {arch!r}; known: {', '.join(sorted(ARCH_PREFIXES))}")
    out = key
    for p in reversed(ARCH_PREFIXES[arch]):
        out = F.when(F.startswith(key, F.lit(p)), F.substr(key, F.lit(len(p) + 1))).otherwise(out)
    return out


def lora_name(bare: Column) -> Column:
    return F.concat(F.lit("lora_unet_"), F.replace(F.regexp_replace(bare, r"\.weight$", ""), F.lit("."), F.lit("_")))


def digits_collapsed(key: Column) -> Column:
    return F.regexp_replace(key, r"\d+", "N")


def quantised_name(path: Column) -> Column:
    """Where a quantised file goes by default: the first dtype token of its name gives way, or the name grows."""
    folder, name = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    named = F.when(name.rlike("(?i)bf16|fp16|fp32"), F.regexp_replace(name, r"(?i)^(.*?)(?:bf16|fp16|fp32)", "$1int8_convrot")).otherwise(F.concat(name, F.lit("_int8_convrot")))
    return F.concat(folder, named, F.lit(".safetensors"))


def smart_resize(h: Column, w: Column, most: int = 589_824, least: int = 1024, factor: int = 32) -> Column:
    """(h, w) rounded to the factor, then shrunk or grown to keep the area within bounds."""
    f = F.lit(factor)
    near = lambda x: F.greatest(F.round(x / f).cast("long") * f, f)
    area = h.cast("double") * w
    down, up = F.sqrt(area / most), F.sqrt(F.lit(float(least)) / area)
    floor = lambda x: F.greatest(F.floor(F.floor(F.greatest(x / down, F.lit(1.0))) / f) * f, f)
    ceil = lambda x: F.greatest(F.ceil(F.floor(x * up) / f) * f, f)
    cur = near(h) * near(w)
    pick = lambda x: F.when(cur > most, floor(x)).when(cur < least, ceil(x)).otherwise(near(x)).cast("int")
    return F.struct(pick(h).alias("h"), pick(w).alias("w"))


def fit_max_edge(w: Column, h: Column, edge: int) -> Column:
    """(w, h) scaled so that the longer edge is at most `edge`; 0 keeps them."""
    long = F.greatest(w, h)
    scale = (F.lit(edge).cast("float") / long).cast("float")
    new = lambda x: F.when((F.lit(edge) == 0) | (long <= edge), x).otherwise(F.greatest(F.round((x.cast("float") * scale).cast("float")).cast("int"), F.lit(1))).cast("int")
    return F.struct(new(w).alias("w"), new(h).alias("h"))


def backoff_seconds(attempt: Column) -> Column:
    """1, 2, 4 ... up to 30."""
    return F.least(F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(10))), F.lit(30.0)).cast("long")


def position_ids(n: Column, pad: Column, vision: Column, grid_h: Column, grid_w: Column, merge: int = 2) -> Column:
    """Three rows of positions for text, an image of merged patches, and text after; with the next text position."""
    gh, gw = F.floor(grid_h / merge).cast("long"), F.floor(grid_w / merge).cast("long")
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0).cast("long"), (k - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    image = upto(vision)
    inner = lambda k: k % (gh * gw)
    axes = [F.transform(image, f) for f in (lambda k: pad + F.floor(k / (gh * gw)), lambda k: pad + F.floor(inner(k) / gw), lambda k: pad + inner(k) % gw)]
    after = F.greatest(F.coalesce(F.array_max(F.array_union(F.array_union(axes[0], axes[1]), axes[2])), pad - 1), pad - 1) + 1
    tail = F.transform(upto(n - pad - vision), lambda k: after + k)
    row = lambda axis: F.concat(upto(pad), axis, tail)
    return F.struct(row(axes[0]).alias("t"), row(axes[1]).alias("h"), row(axes[2]).alias("w"), (after + F.size(tail)).alias("next"))
