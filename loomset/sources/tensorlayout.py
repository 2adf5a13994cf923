"""The layout of safetensors files. Light on imports: every planning process of the data source loads it."""

from __future__ import annotations

import json
import struct
from math import prod

#: Bytes of an element.
SIZES = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U8": 1, "BOOL": 1, "F8_E5M2": 1, "F8_E4M3": 1}
#: Fixed value: the header is padded to so many bytes.
PADDING = 256


def header(path: str) -> tuple[dict, int, int]:
    """(header, where data begin, file size); fails on offsets that don't fit."""
    with open(path, "rb") as f:
        size = f.seek(0, 2)
        f.seek(0)
        if size < 8:
            raise ValueError("too short for a header")
        n = struct.unpack("<Q", f.read(8))[0]
        if n > size - 8:
            raise ValueError("the header is longer than the file")
        tree = json.loads(f.read(n))
    for key, x in tree.items():
        if key != "__metadata__":
            a, b = x["data_offsets"]
            if not 0 <= a <= b <= size - 8 - n or b - a != SIZES[x["dtype"]] * prod(x["shape"]):
                raise ValueError(f"{key}: offsets don't fit")
    return tree, 8 + n, size
