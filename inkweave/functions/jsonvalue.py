"""JSON values in a form in which equal values are equal texts."""

from __future__ import annotations

import hashlib
import json


def canonical(value: object) -> str:
    """A text that two JSON values share exactly if they are the same value.

    The order of keys and of array elements, white space, escapes and the spelling of numbers (1, 1.0,
    1e0) make no difference, nor does a member that is null against one that is missing.
    """
    if isinstance(value, str):
        return f"{len(value)}:{value}"  # the length in front makes quoting needless
    if isinstance(value, dict):
        return "{" + ",".join([f"{len(k)}:{k}={canonical(value[k])}" for k in sorted(value) if value[k] is not None]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(sorted([canonical(v) for v in value])) + "]"
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return repr(value)


def ordered(value: object) -> str:
    """As :func:`canonical`, but the order of array elements counts, and so does a null member."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{ordered(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(ordered, value)) + "]"
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value)


def canonical_text(text: str | None) -> str:
    """:func:`canonical` of a JSON text. A null or blank text is a JSON null; a text that is no JSON stands for itself, trimmed."""
    if text is None or not (text := text.strip()):
        return canonical(None)
    try:
        return canonical(json.loads(text))
    except (ValueError, RecursionError):
        return "text " + text


def digest(parts: list[str]) -> str:
    """128 bits of a list of texts, in hexadecimal."""
    h = hashlib.blake2b(digest_size=16)
    for part in parts:
        data = part.encode("utf-8", "surrogatepass")
        h.update(len(data).to_bytes(8, "little") + data)
    return h.hexdigest()


def embedded_object(text: str | None) -> dict | None:
    """The JSON object from a text's first brace to its last, or None if there is no valid one."""
    if not text:
        return None
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        return None
    try:
        value = json.loads(text[start : end + 1])
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None
