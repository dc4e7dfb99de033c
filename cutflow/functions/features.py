"""Small vectors: keyword features of a query, histograms, window distances of frame fingerprints."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

DIM, BINS, START = 30, 8, 5
#: Words, dimension and value they set (fixed values).
RULES = [
    (["亮", "明亮", "高光", "bright", "brightly", "luminous", "light"], 0, 0.95),
    (["暗", "昏暗", "黑暗", "夜景", "dark", "darkness", "dim", "night"], 0, 0.05),
    (["高对比", "对比强", "high contrast", "contrasty"], 1, 0.9),
    (["低对比", "灰蒙蒙", "flat", "low contrast"], 1, 0.1),
    (["鲜艳", "浓烈", "高饱和", "vivid", "colorful", "saturated", "colourful"], 2, 0.9),
    (["素雅", "低饱和", "淡", "desaturated", "pale", "muted"], 2, 0.12),
    (["暖", "暖色", "夕阳", "warm", "orange", "golden", "sunset"], 3, 0.85),
    (["冷", "冷色", "蓝调", "cool", "cold", "blue tone"], 3, 0.15),
    (["锐", "清晰", "细节多", "sharp", "detailed", "crisp"], 4, 0.85),
    (["模糊", "柔和", "虚化", "blur", "blurry", "soft", "bokeh"], 4, 0.1),
]
#: Colour words and the channels they raise (fixed values).
COLORS = [(["红", "red", "橙", "orange", "黄", "yellow", "紫", "purple", "magenta"], 0), (["绿", "green", "青", "cyan", "黄", "yellow"], 1), (["蓝", "blue", "紫", "purple", "magenta"], 2)]
WHITE, BLACK = ["白", "white"], ["黑", "black"]


def rules_by_dimension() -> dict[int, list[tuple[list[str], float]]]:
    """For each dimension its rules, the one that wins first."""
    out: dict[int, list[tuple[list[str], float]]] = {i: [] for i in range(DIM)}
    for words, dim, value in RULES:
        out[dim].insert(0, (words, value))
    for words, c in COLORS:
        out[START + c * BINS + 5].insert(0, (words, 0.95))
    for dim, value in [(2, 0.05), (0, 0.9), *[(START + c * BINS + 7, 0.95) for c in range(3)]]:
        out[dim].insert(0, (WHITE, value))
    for dim, value in [(0, 0.05), *[(START + c * BINS, 0.95) for c in range(3)]]:
        out[dim].insert(0, (BLACK, value))
    return out


def text_vector(text: Column) -> Column:
    """Unit vector of DIM keyword features; zeros if the text names none."""
    from .text import has_any

    t = F.lower(F.coalesce(text, F.lit("")))
    raw = F.array(*[F.coalesce(*[F.when(has_any(t, w), F.lit(v)) for w, v in rules], F.lit(0.5)) - 0.5 if rules else F.lit(0.0) for rules in rules_by_dimension().values()])
    return l2(raw)


def l2(v: Column) -> Column:
    """An array scaled to length 1; zeros stay."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def histogram_bin(x: Column, bins: int = BINS) -> Column:
    """Bin of a value in [0, 1]; the last one is closed."""
    return F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int")


def window_mse(a: Column, b: Column, size: int = 4, flat: float = 2.0) -> Column:
    """Least mean squared difference of any `size` frames of a (every second start) with any of b.

    Windows of a that vary less than `flat` are skipped; infinite below `size` frames. Frames are arrays of one length."""
    inf = F.lit(float("inf"))
    pick = lambda x, i: F.flatten(F.slice(x, i + 1, size))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    std = lambda v: F.sqrt(F.greatest(mean(F.transform(v, lambda x: x * x)) - F.pow(mean(v), F.lit(2.0)), F.lit(0.0)))
    mse = lambda u, v: mean(F.zip_with(u, v, lambda x, y: (x - y) * (x - y)))
    starts = lambda x, step: F.sequence(F.lit(0), F.size(x) - size, F.lit(step))
    best = F.array_min(F.transform(starts(a, 2), lambda i: F.when(std(pick(a, i)) < flat, inf).otherwise(F.array_min(F.transform(starts(b, 1), lambda j: mse(pick(a, i), pick(b, j)))))))
    return F.when((F.size(a) < size) | (F.size(b) < size), inf).otherwise(best)


def lerp_expression(keys: Column) -> Column:
    """keys: array of struct(t, v), in order, as text -> nested if(lt(t,..),..) expression of straight lines."""
    text = lambda x: x.cast("string")
    n = F.size(keys)
    last = text(F.element_at(keys, -1)["v"])

    def around(tail: Column, i: Column) -> Column:
        a, b = F.get(keys, i), F.get(keys, i + 1)
        line = F.concat(text(a["v"]), F.lit("+("), text(b["v"] - a["v"]), F.lit(")*(t-"), text(a["t"]), F.lit(")/"), text(b["t"] - a["t"]))
        return F.concat(F.lit("if(lt(t,"), text(b["t"]), F.lit("),"), line, F.lit(","), tail, F.lit(")"))

    return F.when(n <= 1, last).otherwise(F.aggregate(F.sequence(n - 2, F.lit(0), F.lit(-1)), last, around))
