"""The subset of RON that records are written in: nameless structs, lists, maps, strings, numbers, booleans and options.

Small helpers of the record source and sink, which run them on one record each.
"""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r"""\s*(?://[^\n]*\s*|/\*.*?\*/\s*)*(?:(?P<raw>r(?P<h>\#*)"(?P<body>.*?)"(?P=h))|(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>[+-]?(?:\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?|inf|NaN))|(?P<id>[A-Za-z_]\w*)|(?P<p>[()\[\]{},:])|(?P<end>\Z))""", re.S)
_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})|(\n\s*)|(.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def _unquoted(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else "" if m[3] else _PLAIN.get(m[4], m[4]), text[1:-1])


def loads(text: str):
    """Structs and maps as dicts, lists as lists, None and Some(x) as None and x."""
    place = 0

    def take():
        nonlocal place
        m = _TOKEN.match(text, place)
        if not m:
            raise ValueError(f"unexpected {text[place : place + 20]!r} at {place}")
        place = m.end()
        if m["raw"] is not None:
            return "str", m["body"]
        if m["str"] is not None:
            return "str", _unquoted(m["str"])
        return next((k, m[k]) for k in ("num", "id", "p", "end") if m[k] is not None)

    def items(close: str, keyed: bool):
        out: list = []
        kind, x = take()
        while (kind, x) != ("p", close):
            v = value(kind, x)
            if keyed:
                need(":")
                v = (v, value(*take()))
            out.append(v)
            kind, x = take()
            if (kind, x) == ("p", ","):
                kind, x = take()
            elif (kind, x) != ("p", close):
                raise ValueError(f"expected , or {close} before {place}")
        return out

    def need(p: str):
        if take() != ("p", p):
            raise ValueError(f"expected {p} before {place}")

    def value(kind: str, x: str):
        if kind == "str":
            return x
        if kind == "num":
            x = x.replace("_", "")
            return int(x) if re.fullmatch(r"[+-]?\d+", x) else float(x)
        if kind == "id":
            if x == "Some":
                need("(")
                inner = value(*take())
                after = take()
                if after == ("p", ","):
                    after = take()
                if after != ("p", ")"):
                    raise ValueError(f"expected ) before {place}")
                return inner
            return {"true": True, "false": False, "None": None, "inf": float("inf"), "NaN": float("nan")}.get(x, x)
        if kind == "p" and x == "[":
            return items("]", False)
        if kind == "p" and x in "({":
            return dict(items(")" if x == "(" else "}", True))
        raise ValueError(f"unexpected {x!r} before {place}")

    out = value(*take())
    if take()[0] != "end":
        raise ValueError(f"text after the value at {place}")
    return out


class Some:
    """An option that holds something, for writing."""

    def __init__(self, value) -> None:
        self.value = value


class Map(dict):
    """A map, for writing; other dicts are structs."""


def dumps(value, indent: str = "") -> str:
    deeper = indent + "  "
    lines = lambda a, xs, z: a + z if not xs else a + "\n" + "".join(f"{deeper}{x},\n" for x in xs) + indent + z
    if isinstance(value, Some):
        return f"Some({dumps(value.value, indent)})"
    if value is None:
        return "None"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, Map):
        return lines("{", [f"{dumps(k)}: {dumps(v, deeper)}" for k, v in sorted(value.items())], "}")
    if isinstance(value, dict):
        return lines("(", [f"{k}: {dumps(v, deeper)}" for k, v in value.items()], ")")
    if isinstance(value, list):
        return lines("[", [dumps(v, deeper) for v in value], "]")
    if isinstance(value, str):
        return re.sub(r"\\u([0-9a-f]{4})", r"\\u{\1}", json.dumps(value, ensure_ascii=False))
    return repr(value)
