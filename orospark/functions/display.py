"""Column functions for showing tilesets: rectangles, spans, colours and readable numbers."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
# Colour stops (position, RRGGBB) of the display ramps.
RAMPS = {
    "hypsometric": ((0.0, "00204d"), (0.15, "1d6cb4"), (0.35, "3cb371"), (0.55, "ffd700"), (0.75, "d33038"), (1.0, "ffffff")),
    "ocean": ((0.0, "0a1e5e"), (0.25, "134e9a"), (0.5, "2a9df4"), (0.75, "7ec8e3"), (1.0, "e8f7ff")),
    "terrain": ((0.0, "1a4d1a"), (0.3, "3d8b37"), (0.55, "a67c52"), (0.8, "8b4513"), (1.0, "f5f5dc")),
    "slope": ((0.0, "000000"), (0.29, "2747e0"), (0.5, "d33b7d"), (0.7071, "d33038"), (0.87, "ff9742"), (0.91, "ffd700"), (1.0, "ffffff")),
    "aspect": ((0.0, "000000"), (0.2, "2747e0"), (0.4, "d33b7d"), (0.6, "d33038"), (0.8, "ff9742"), (0.9, "ffd700"), (1.0, "ffffff")),
}
RAMP_STEPS = 256
MIN_HEIGHT, MAX_HEIGHT = -500.0, 3000.0
# Fixed value: shown for what isn't known.
DASH = "—"


def tile_rectangle(zoom: Column, start_x: Column, start_y: Column, end_x: Column, end_y: Column) -> Column:
    """Degrees covered by a range of geodetic tiles, two at zoom 0."""
    nx, ny = F.pow(F.lit(2.0), zoom + 1), F.pow(F.lit(2.0), zoom)
    lon, lat = lambda x: F.lit(-180.0) + x * (F.lit(360.0) / nx), lambda y: F.lit(-90.0) + y * (F.lit(180.0) / ny)
    return F.struct(lon(start_x).alias("west"), lat(start_y).alias("south"), lon(end_x + 1).alias("east"), lat(end_y + 1).alias("north"))


def span_metres(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The longer side of a rectangle in degrees, width at its middle latitude."""
    width = F.radians(east - west) * EARTH_RADIUS * F.cos(F.radians((south + north) / 2))
    return F.greatest(F.abs(width), F.abs(F.radians(north - south) * EARTH_RADIUS))


def camera_height(span: Column) -> Column:
    return F.least(F.greatest(span * 0.55, F.lit(3000.0)), F.lit(120000.0))


def exaggeration(c: Column) -> Column:
    return F.least(F.greatest(F.coalesce(c, F.lit(1.0)), F.lit(1.0)), F.lit(50.0))


def ramp_step(value: Column, low: Column, high: Column, steps: int = RAMP_STEPS) -> Column:
    """The step of the ramp, from 0, that a value falls in; ends are clamped, null stays null. high has to be over low."""
    t = F.floor((value - low) * steps / (high - low))
    return F.when(value.isNotNull(), F.least(F.greatest(t, F.lit(0)), F.lit(steps - 1))).cast("int")


def ramp_colour(step: Column, ramp: str = "hypsometric", steps: int = RAMP_STEPS) -> Column:
    """#rrggbb of a step: linear between the stops, each channel rounded half up, at the step's middle."""
    t, out = (step + 0.5) / steps, F.lit(None).cast("string")
    for (a, x), (b, y) in reversed(list(pairwise(RAMPS[ramp]))):
        part = (t - a) / (b - a)
        channels = [F.lit(int(x[k : k + 2], 16)) + part * (int(y[k : k + 2], 16) - int(x[k : k + 2], 16)) for k in (0, 2, 4)]
        colour = F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(F.floor(c + 0.5).cast("long")), 2, "0")) for c in channels])
        out = F.when(t <= b, colour).otherwise(out)
    return out


def checked_range(low: float, high: float) -> tuple[float, float]:
    if not high > low:
        raise ValueError("the greatest height has to be over the least")
    return low, high


def shade(value: Column, ramp: str, low: float, high: float, contour: Column | None = None, contour_colour: str = "#ffffff") -> Column:
    """Colour of a cell: that of the contour where one runs, else the ramp's; null for nodata off a contour."""
    low, high = checked_range(low, high)
    colour = ramp_colour(ramp_step(value, F.lit(low), F.lit(high)), ramp)
    return colour if contour is None else F.when(contour, F.lit(contour_colour)).otherwise(colour)


def fixed(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", c.cast("double"))


def show_degrees(c: Column, positive: str, negative: str) -> Column:
    text = F.concat(F.when(c >= 0, F.lit(positive)).otherwise(F.lit(negative)), fixed(F.abs(c), 5), F.lit("°"))
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(DASH)).otherwise(text)


def show_height(c: Column) -> Column:
    text = F.when(c < 0, F.concat(fixed(c, 1), F.lit(" m（椭球面下）"))).when(F.abs(c) < 0.05, F.lit("0.0 m（椭球面）")).otherwise(F.concat(fixed(c, 1), F.lit(" m")))
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(DASH)).otherwise(text)


def show_zooms(least: Column, most: Column) -> Column:
    text = F.when(least == most, least.cast("string")).otherwise(F.concat(least.cast("string"), F.lit("–"), most.cast("string")))
    return F.when(least.isNull() | most.isNull(), F.lit(DASH)).otherwise(text)


def half_up(c: Column, places: int) -> Column:
    """Fixed places, halves up after scaling in doubles: the decimal digits of c alone differ from that in large numbers."""
    return fixed(F.floor(c * 10**places + 0.5) / 10**places, places)


def show_size(c: Column) -> Column:
    k, m, g = 1 << 10, 1 << 20, 1 << 30
    text = F.when(c < k, F.concat(c.cast("long").cast("string"), F.lit(" B"))).when(c < m, F.concat(half_up(c / k, 1), F.lit(" KB"))).when(c < g, F.concat(half_up(c / m, 1), F.lit(" MB"))).otherwise(F.concat(half_up(c / g, 2), F.lit(" GB")))
    return F.coalesce(text, F.lit(""))


def show_elapsed(seconds: Column) -> Column:
    n = F.greatest(F.floor(seconds), F.lit(0))
    h, m, s = F.floor(n / 3600), F.floor((n % 3600) / 60), n % 60
    part = lambda x, unit: F.concat(x.cast("long").cast("string"), F.lit(unit))
    text = F.when(h > 0, F.concat(part(h, "小时"), part(m, "分"), part(s, "秒"))).when(m > 0, F.concat(part(m, "分"), part(s, "秒"))).otherwise(part(s, "秒"))
    return F.coalesce(text, F.lit(DASH))


def show_percent(c: Column) -> Column:
    p = F.least(F.greatest(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(100.0))
    tenth = F.floor(p * 10 + 0.5) / 10
    return F.concat(F.when(p % 1 == 0, F.format_string("%.0f", tenth)).otherwise(F.format_string("%.1f", tenth)), F.lit("%"))
