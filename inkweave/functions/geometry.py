"""Numbers, axes, colours and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nice_number(value: Column, nearest: bool = True) -> Column:
    """1, 2, 5 or 10 times a power of ten, nearest or next above; null for values that aren't positive."""
    power = F.floor(F.log10(value))
    part = value / F.pow(F.lit(10.0), power)
    steps = ((1.5, 1), (3, 2), (7, 5)) if nearest else ((1, 1), (2, 2), (5, 5))
    chosen = F.lit(10)
    for bound, step in reversed(steps):
        chosen = F.when(part < bound if nearest else part <= bound, step).otherwise(chosen)
    return F.when(value > 0, chosen * F.pow(F.lit(10.0), power))


def axis(top: Column, ticks: int = 5) -> tuple[Column, Column]:
    """An axis from 0 for values up to ``top``: its step and its end, a whole number of steps; nulls below 0."""
    span = F.when(top == 0, F.lit(1.0)).otherwise(top)
    step = nice_number(span / ticks)
    return step, F.ceil(top / step) * step


def scaled_threshold(base: Column, seconds: Column, mode: str = "sqrt") -> Column:
    """A threshold for longer windows: over the root of their length, over their length, or as it is."""
    return {"sqrt": base / F.sqrt(seconds), "linear": base / seconds}.get(mode, base)


def css_color(color: Column) -> Column:
    """An array of 3 or 4 numbers as a CSS colour, alpha out of 255 with three decimals; null for other lengths."""
    three = F.format_string("rgb(%d,%d,%d)", color[0], color[1], color[2])
    four = F.format_string("rgba(%d,%d,%d,%.3f)", color[0], color[1], color[2], color[3] / F.lit(255.0))
    return F.when(F.size(color) == 3, three).when(F.size(color) == 4, four)


def on_circle(index: Column, count: Column, x: float, y: float, radius: float) -> tuple[Column, Column, Column]:
    """The angle and place of one of several equally spaced points, the first at twelve o'clock."""
    angle = F.lit(2.0) * F.pi() * index / count - F.pi() / 2
    return angle, F.lit(x) + radius * F.cos(angle), F.lit(y) + radius * F.sin(angle)


def on_line(index: Column, start: float, step: float) -> Column:
    """The place of one of several points in a row."""
    return F.lit(start) + index * F.lit(step)


def large_arc(begin: Column, end: Column) -> Column:
    """SVG's flag of an arc of more than half a turn."""
    return (F.pmod(end - begin, F.lit(2.0) * F.pi()) > F.pi()).cast("int")


def arc_path(radius: Column, x1: Column, y1: Column, x2: Column, y2: Column, large: Column) -> Column:
    """The path of an arc between two points."""
    return F.format_string("M %.2f %.2f A %.2f %.2f 0 %d 1 %.2f %.2f", x1, y1, radius, radius, large, x2, y2)


def svg_circle(x: Column, y: Column, radius: Column, stroke: Column, fill: Column | None = None, width: float = 2.0) -> Column:
    """A circle; without a fill it is hollow."""
    return F.format_string('<circle cx="%.2f" cy="%.2f" r="%.2f" stroke="%s" stroke-width="%.1f" fill="%s"/>', x, y, radius, stroke, F.lit(width), F.lit("none") if fill is None else fill)


def svg_square(x: Column, y: Column, side: Column, fill: Column) -> Column:
    """A square around its middle."""
    return F.format_string('<rect x="%.2f" y="%.2f" width="%.2f" height="%.2f" fill="%s"/>', x - side / 2, y - side / 2, side, side, fill)


def svg_text(x: Column, y: Column, text: Column, size: int = 16, anchor: str = "start") -> Column:
    """A text, with the characters that XML reserves written out."""
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return F.concat(F.format_string(f'<text x="%.2f" y="%.2f" font-size="{size}" text-anchor="{anchor}">', x, y), text, F.lit("</text>"))
