"""Names of the canvas colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The 32 colour codes of the canvas and their names.
PALETTE = {
    "#000000": "Black",
    "#00756F": "Dark Teal",
    "#009EAA": "Teal",
    "#00A368": "Dark Green",
    "#00CC78": "Green",
    "#00CCC0": "Cyan",
    "#2450A4": "Dark Blue",
    "#3690EA": "Blue",
    "#493AC1": "Indigo",
    "#515252": "Dark Gray",
    "#51E9F4": "Light Cyan",
    "#6A5CFF": "Periwinkle",
    "#6D001A": "Dark Red",
    "#6D482F": "Brown",
    "#7EED56": "Light Green",
    "#811E9F": "Purple",
    "#898D90": "Gray",
    "#94B3FF": "Light Periwinkle",
    "#9C6926": "Dark Brown",
    "#B44AC0": "Lavender",
    "#BE0039": "Red",
    "#D4D7D9": "Light Gray",
    "#DE107F": "Magenta",
    "#E4ABFF": "Light Lavender",
    "#FF3881": "Pink",
    "#FF4500": "Orange",
    "#FF99AA": "Light Pink",
    "#FFA800": "Gold",
    "#FFB470": "Peach",
    "#FFD635": "Yellow",
    "#FFF8B8": "Light Yellow",
    "#FFFFFF": "White",
}


def palette_frame(spark) -> DataFrame:
    """The palette as a table `(pc, color)` of 32 rows, known to the planner as tiny."""
    rows = ", ".join(f"('{code}', '{name}')" for code, name in PALETTE.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS palette(pc, color)")


def with_color_name(df: DataFrame) -> DataFrame:
    """Add `color`; a code outside the palette gets NULL and keeps its row."""
    return df.join(F.broadcast(palette_frame(df.sparkSession)), "pc", "left")
