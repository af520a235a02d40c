"""Boxes as structs of x, y, w, h; all expressions are JVM-side."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.functions.probs import let


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))))


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def overlap(a: Column, b: Column) -> Column:
    """Shared area."""
    side = lambda p, s: F.greatest(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]), F.lit(0.0))
    return side("x", "w") * side("y", "h")


def iou(a: Column, b: Column) -> Column:
    """Shared area over the union's; 0 of two empty boxes."""
    s = overlap(a, b)
    return F.coalesce(F.try_divide(s, area(a) + area(b) - s), F.lit(0.0))


def within(a: Column, b: Column) -> Column:
    return (a["x"] >= b["x"]) & (a["y"] >= b["y"]) & (a["x"] + a["w"] <= b["x"] + b["w"]) & (a["y"] + a["h"] <= b["y"] + b["h"])


def crossing(a: Column, b: Column) -> Column:
    """Overlapping, neither within the other."""
    return (overlap(a, b) > 0) & ~within(a, b) & ~within(b, a)


def same_widget(a: Column, b: Column, least: float = 0.7) -> Column:
    return within(a, b) | within(b, a) | (iou(a, b) >= least)


def centre(b: Column) -> tuple[Column, Column]:
    return b["x"] + b["w"] / 2, b["y"] + b["h"] / 2


def relation(a: Column, b: Column, gap: Column | float) -> Column:
    """The one side of ``b`` on which ``a`` clearly lies, else null: centres farther apart than ``gap`` along
    one axis, and no more than that along the other."""
    (ax, ay), (bx, by) = centre(a), centre(b)
    dx, dy = ax - bx, ay - by
    g = F.lit(gap) if isinstance(gap, (int, float)) else gap
    return F.when((F.abs(dx) > g) & (F.abs(dy) <= g), F.when(dx < 0, "left").otherwise("right")).when((F.abs(dy) > g) & (F.abs(dx) <= g), F.when(dy < 0, "above").otherwise("below"))


def pixel_box(frac: Column, width: Column, height: Column) -> Column:
    """A box of fractions in whole pixels, inside the picture and at least one pixel each way."""
    x0 = F.greatest(F.lit(0), F.least(width - 1, F.floor(frac["x"] * width)))
    y0 = F.greatest(F.lit(0), F.least(height - 1, F.floor(frac["y"] * height)))
    x1 = F.greatest(x0 + 1, F.least(width, F.ceil((frac["x"] + frac["w"]) * width)))
    y1 = F.greatest(y0 + 1, F.least(height, F.ceil((frac["y"] + frac["h"]) * height)))
    return F.struct(x0.cast("int").alias("x"), y0.cast("int").alias("y"), (x1 - x0).cast("int").alias("w"), (y1 - y0).cast("int").alias("h"))


def box_grid(b: Column, width: Column, height: Column, cells: int, smooth: float = 0.0) -> Column:
    """Share of the box's area in each of cells x cells squares of the picture, row by row, mixed with the uniform."""
    cw, ch = width / F.lit(float(cells)), height / F.lit(float(cells))
    cell = lambda i: box((i % cells) * cw, F.floor(i / cells) * ch, cw, ch)
    raw = F.transform(F.sequence(F.lit(0), F.lit(cells * cells - 1)), lambda i: overlap(cell(i), b))
    n = float(cells * cells)
    # Lists of one row, so that the cells and their sum are worked out once and not for every cell.
    summed = F.transform(F.array(raw), lambda r: F.struct(r.alias("raw"), F.aggregate(r, F.lit(0.0), lambda s, x: s + x).alias("whole")))
    return F.get(F.transform(summed, lambda s: F.transform(s["raw"], lambda x: F.coalesce(F.try_divide(x, s["whole"]), F.lit(1.0 / n)) * (1 - smooth) + F.lit(smooth / n))), 0)


def views(width: Column, height: Column, n: int, share: float) -> Column:
    """``n`` overlapping views: the rows x columns nearest to square cells, neighbours overlapping by ``share`` of a view."""
    shapes = [(r, n // r) for r in range(1, n + 1) if n % r == 0]
    how = lambda r, c: F.abs(F.log((width / c) / (height / r)))
    best = F.array_min(F.array(*(F.struct(how(r, c).alias("d"), F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in shapes)))
    vw, vh = width / (best["c"] - (best["c"] - 1) * share), height / (best["r"] - (best["r"] - 1) * share)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: box((i % best["c"]) * vw * (1 - share), F.floor(i / best["c"]) * vh * (1 - share), vw, vh))


def tapped(elements: Column, x: Column, y: Column, grow: float = 0.0) -> Column:
    """The smallest element (struct of label and box) that holds the point; null if none does or if the
    label of that one stands on another element that holds it too."""
    holds = lambda e: (e["box"]["x"] - grow <= x) & (x <= e["box"]["x"] + e["box"]["w"] + grow) & (e["box"]["y"] - grow <= y) & (y <= e["box"]["y"] + e["box"]["h"] + grow)
    hit = F.array_sort(F.transform(F.filter(elements, holds), lambda e: F.struct(area(e["box"]).alias("area"), e["label"].alias("label"))))
    first = F.get(hit, F.lit(0))
    return F.when(F.size(F.filter(elements, lambda e: e["label"] == first["label"])) == 1, first["label"])


def boxes_grid(bs: Column, width: Column, height: Column, cells: int, smooth: float = 0.0) -> Column:
    """As :func:`box_grid` for a list of boxes: what each square holds of all of them together; the uniform of an empty list."""
    n = float(cells * cells)
    each = F.transform(bs, lambda b: box_grid(b, width, height, cells))
    areas = F.transform(bs, area)
    both = F.arrays_zip(each.alias("g"), areas.alias("a"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(cells * cells - 1)), lambda i: F.aggregate(both, F.lit(0.0), lambda s, x: s + F.get(x["g"], i) * x["a"]))
    return let(F.struct(raw.alias("r"), F.aggregate(raw, F.lit(0.0), lambda s, x: s + x).alias("t")), lambda x: F.transform(x["r"], lambda v: F.coalesce(F.try_divide(v, x["t"]), F.lit(1.0 / n)) * (1 - smooth) + F.lit(smooth / n)))


def patches(view: Column, width: Column, height: Column, size: int, side: int) -> Column:
    """The side x side patches of a view that is fitted into a square of ``size`` with even margins, row by row: centre and
    size of each in parts of the whole picture. Patches over the margins lie outside the view."""
    scale = F.lit(float(size)) / F.greatest(view["w"], view["h"])
    margin = lambda d: F.floor((F.lit(size) - F.greatest(F.lit(1.0), F.bround(view[d] * scale))) / 2)
    cell = size / side
    at = F.struct(view.alias("v"), scale.alias("s"), margin("w").alias("mx"), margin("h").alias("my"))

    def one(x: Column, i: Column) -> Column:
        cx = x["v"]["x"] + ((i % side + 0.5) * cell - x["mx"]) / x["s"]
        cy = x["v"]["y"] + ((F.floor(i / side) + 0.5) * cell - x["my"]) / x["s"]
        return F.struct((cx / width).alias("cx"), (cy / height).alias("cy"), (cell / x["s"] / width).alias("w"), (cell / x["s"] / height).alias("h"))

    return let(at, lambda x: F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: one(x, i)))


def region(b: Column, view: Column, width: Column, height: Column, size: int, side: int) -> Column:
    """The patches of a view that a box touches inside it: number, row and column from the first touched ones, and where the
    patch lies in units of the box. Rows and columns are tested apart from each other, 2 x side of them instead of side x side."""
    cell = size / side
    scale = F.lit(float(size)) / F.greatest(view["w"], view["h"])
    margin = lambda d: F.floor((F.lit(size) - F.greatest(F.lit(1.0), F.bround(view[d] * scale))) / 2)
    at = F.struct(view.alias("v"), b.alias("b"), (F.lit(cell) / scale).alias("p"), (margin("w") / scale).alias("mx"), (margin("h") / scale).alias("my"))

    def touched(x: Column, o: str, e: str, m: str) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.struct(i.alias("i"), (x["v"][o] + i * x["p"] - x[m]).alias("at")))
        return F.filter(starts, lambda s: F.least(s["at"] + x["p"], x["v"][o] + x["v"][e], x["b"][o] + x["b"][e]) - F.greatest(s["at"], x["v"][o], x["b"][o]) > 1e-9)

    def placed(x: Column) -> Column:
        one = lambda r, c: F.struct(
            (r["i"] * side + c["i"]).alias("patch"), (r["i"] - F.get(x["r"], F.lit(0))["i"]).alias("row"), (c["i"] - F.get(x["c"], F.lit(0))["i"]).alias("col"),
            ((c["at"] + x["x"]["p"] / 2 - x["x"]["b"]["x"]) / x["x"]["b"]["w"]).alias("x"), ((r["at"] + x["x"]["p"] / 2 - x["x"]["b"]["y"]) / x["x"]["b"]["h"]).alias("y"), (x["x"]["p"] / x["x"]["b"]["w"]).alias("w"), (x["x"]["p"] / x["x"]["b"]["h"]).alias("h"),
        )
        return F.flatten(F.transform(x["r"], lambda r: F.transform(x["c"], lambda c: one(r, c))))

    return let(at, lambda x: let(F.struct(x.alias("x"), touched(x, "y", "h", "my").alias("r"), touched(x, "x", "w", "mx").alias("c")), placed))


def tap(elements: Column, x: Column, y: Column, grow: float, least: float = 0.7) -> Column:
    """(label, reason) of the tapped element of a screen (structs of label, nav, box): among those that hold the point, else
    those that do when grown, the smallest; with a reason instead of a label where none does, a navigation bar does, their
    labels differ, the label is unreadable, or another widget elsewhere has it too."""
    holds = lambda e, g: (e["box"]["x"] - g <= x) & (x <= e["box"]["x"] + e["box"]["w"] + g) & (e["box"]["y"] - g <= y) & (y <= e["box"]["y"] + e["box"]["h"] + g)
    exact, wide = F.filter(elements, lambda e: holds(e, 0.0)), F.filter(elements, lambda e: holds(e, grow))

    def found(hit: Column) -> Column:
        labels = F.array_distinct(F.transform(hit, lambda e: F.lower(e["label"])))
        first = F.get(F.array_sort(F.transform(hit, lambda e: F.struct(area(e["box"]).alias("area"), e["label"].alias("label"), e["box"].alias("box")))), F.lit(0))
        twin = F.exists(elements, lambda e: (F.lower(e["label"]) == F.lower(first["label"])) & ~F.exists(hit, lambda k: k == e) & ~same_widget(e["box"], first["box"], least))
        reason = F.when(F.size(hit) == 0, "no element").when(F.exists(hit, lambda e: F.coalesce(e["nav"], F.lit(False))), "navigation bar").when(F.size(labels) > 1, "ambiguous").when(~F.coalesce(first["label"].rlike(r"\p{L}|\p{N}"), F.lit(False)), "unreadable").when(twin, "label twice")
        return F.struct(F.when(reason.isNull(), first["label"]).alias("label"), reason.alias("reason"))

    return let(F.when(F.size(exact) > 0, exact).otherwise(wide), found)


def crop_window(b: Column, width: Column, height: Column, crop_w: float, crop_h: float, u: Column) -> Column:
    """A window of the crop's size at the left edge that holds the box's height, placed by ``u`` in [0, 1); null if the box is beyond the page or too high."""
    h = F.least(F.lit(float(crop_h)), height)
    low, high = F.greatest(F.lit(0.0), F.floor(b["y"] + b["h"]) - h + 1), F.least(F.floor(b["y"]), height - h)
    good = (b["x"] >= 0) & (b["y"] >= 0) & (b["x"] + b["w"] <= width + 1) & (b["y"] + b["h"] <= height + 1) & (b["h"] <= h) & (high >= low)
    return F.when(good, box(F.lit(0.0), low + F.floor(u * (high - low + 1)), F.least(F.lit(float(crop_w)), width), h))


def backprojected(cx: Column, cy: Column, depth: Column, width: Column, height: Column, view: float = 60.0) -> Column:
    """A pixel with its depth as a point in space, for a camera that sees ``view`` degrees across."""
    f = width / (2 * math.tan(math.radians(view) / 2))
    return F.struct(((cx - width / 2) * depth / f).alias("x"), ((cy - height / 2) * depth / f).alias("y"), depth.alias("z"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "xyz"), F.lit(0.0)))


def closer_of_two(anchor: Column, a: Column, b: Column, ratio: float, gap: float) -> Column:
    """``a`` or ``b``, which of two points is clearly closer to the anchor; null if the distances are too much alike."""
    da, db = distance(anchor, a), distance(anchor, b)
    near, far = F.least(da, db), F.greatest(da, db)
    return F.when((near > 0) & (far / near >= ratio) & (far - near >= gap), F.when(da < db, "a").otherwise("b"))
