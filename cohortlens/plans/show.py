"""Results as text, tables and SVG for people to look at; nothing here is drawn by a plotting library."""

from __future__ import annotations

import colorsys
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def colours(n: int) -> list[str]:
    """n colours as #rrggbb, hues a golden angle apart, so that the first ones differ most."""
    out = []
    for i in range(n):
        r, g, b = colorsys.hsv_to_rgb(i * 0.381966 % 1, 0.65 + 0.3 * (i % 2), 0.9 - 0.25 * (i % 3))
        out.append(f"#{round(r * 255):02x}{round(g * 255):02x}{round(b * 255):02x}")
    return out


def bars(rows: list[tuple[str, float]], width: int = 40) -> str:
    """Named numbers as bars of text, the largest first."""
    most, name = max((x for _, x in rows), default=0) or 1, max((len(n) for n, _ in rows), default=0)
    return "\n".join(f"{n.ljust(name)} {'#' * round(width * x / most)} {x:g}" for n, x in sorted(rows, key=lambda r: (-r[1], r[0])))


def class_share_bars(shares: DataFrame, names: list[str] | None = None) -> str:
    """Shares (label, share) of the classes as bars; one row a class comes to the driver."""
    return bars([(names[r["label"]] if names else str(r["label"]), r["share"]) for r in shares.collect()])


def area_histogram(areas: DataFrame, bins: int = 10) -> DataFrame:
    """(label, bin, low, high, n): how many boxes of each class lie in each of so many equal ranges of its areas."""
    ends = areas.groupBy("label").agg(F.min("area").alias("a"), F.max("area").alias("z"))
    width = F.greatest((F.col("z") - F.col("a")) / bins, F.lit(1e-12))
    at = F.least(F.floor((F.col("area") - F.col("a")) / width), F.lit(bins - 1)).cast("int")
    rows = areas.join(ends, "label").select("label", at.alias("bin"), (F.col("a") + at * width).alias("low"), (F.col("a") + (at + 1) * width).alias("high"))
    return rows.groupBy("label", "bin", "low", "high").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "bin")


def boxes_svg(labels: DataFrame, predictions: DataFrame, image_id: int, size: tuple[int, int], threshold: float = 0.0, names: list[str] | None = None) -> str:
    """One image's given boxes (solid) and likely predicted boxes (dashed) as an SVG."""
    own = [(r, "") for r in labels.where(F.col("image_id") == image_id).collect()]
    guessed = [(r, ' stroke-dasharray="6 3"') for r in predictions.where((F.col("image_id") == image_id) & (F.col("p") >= threshold)).collect()]
    paint = colours(1 + max((r["label"] for r, _ in own + guessed), default=0))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{size[0]}" height="{size[1]}">']
    for r, dash in own + guessed:
        c, name = paint[r["label"]], names[r["label"]] if names else str(r["label"])
        note = f"{name} {r['p']:.2f}" if dash else name
        out.append(f'<rect x="{r["x1"]}" y="{r["y1"]}" width="{r["x2"] - r["x1"]}" height="{r["y2"] - r["y1"]}" fill="none" stroke="{c}"{dash}/>')
        out.append(f'<text x="{r["x1"]}" y="{r["y1"] - 2}" fill="{c}" font-size="10">{escape(note)}</text>')
    return "\n".join([*out, "</svg>"])


def pixels_svg(pixels: DataFrame, issues: DataFrame, image_id: int, scale: int = 4) -> str:
    """One image's given classes as coloured squares, flagged pixels framed in red, as an SVG."""
    flagged = {(r["y"], r["x"]) for r in issues.where(F.col("image_id") == image_id).collect()}
    rows = pixels.where(F.col("image_id") == image_id).select("y", "x", "label").collect()
    paint = colours(1 + max((r["label"] for r in rows), default=0))
    high, wide = (max((r[c] for r in rows), default=-1) + 1 for c in ("y", "x"))
    squares = [
        f'<rect x="{r["x"] * scale}" y="{r["y"] * scale}" width="{scale}" height="{scale}" fill="{paint[r["label"]]}"' + (' stroke="red"/>' if (r["y"], r["x"]) in flagged else "/>")
        for r in sorted(rows, key=lambda r: (r["y"], r["x"]))
    ]
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide * scale}" height="{high * scale}">', *squares, "</svg>"])
