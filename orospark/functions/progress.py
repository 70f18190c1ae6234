"""Column functions that read progress from logs and put it on the scale of the whole job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from orospark.functions.labels import strip

# Stages with their part of the whole job, in percent.
STAGE_RANGES = {"queued": (0.0, 0.0), "initializing": (0.0, 2.0), "gdal_preprocess": (2.0, 25.0), "ctb_tile": (25.0, 95.0), "register_tileset": (95.0, 99.0), "done": (100.0, 100.0), "failed": (0.0, 100.0)}
TILING_STAGES = ("ctb_tile", "gdal_raster_tile")
JOB_STATUSES = ("queued", "running", "preprocessing", "tiling", "publishing", "completed", "failed")
STATUS_STAGES = {"queued": "queued", "completed": "done", "failed": "failed", "preprocessing": "gdal_preprocess", "tiling": "ctb_tile", "publishing": "register_tileset", "running": "running"}
# Patterns of progress output.
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
DOT_STEP = r"(?:^|\.{3})(\d+)(?=\.{3}|$|\s|-)"
DONE = r"(?i)\b100\b.*\bdone\b"
ZOOM = r"(?i)(?:zoom(?:\s+level)?|overview(?:\s+for)?(?:\s+zoom(?:\s+level)?)?)[\s:=\-]*(\d+)"


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _largest(text: Column, pattern: str) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("double")))


def parse_progress(text: Column, current: Column, strict: bool = True) -> Column:
    """Percent after a piece of log: the largest of what it was and of the steps and percents named, 100 when done.

    With strict off, dot steps over 100 (years, counts) are left out instead of counting as 100."""
    steps = F.regexp_extract_all(text, F.lit(DOT_STEP), F.lit(1))
    steps = F.transform(steps, lambda x: x.cast("double"))
    if not strict:
        steps = F.filter(steps, lambda x: x <= 100)
    best = F.greatest(current.cast("double"), F.array_max(steps), _largest(text, PERCENT))
    done = text.rlike(DONE) | F.lower(text).contains("100 - done")
    return clamp(F.when(done, F.lit(100.0)).otherwise(best), 0.0, 100.0)


def parse_zoom(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, ZOOM, 1), F.lit("")).cast("int")


def overall_percent(stage: Column, sub: Column, ranges: dict[str, tuple[float, float]] | None = None) -> Column:
    """Sub-percent of a stage on the scale of the job, two places; an unknown stage is the whole job."""
    bounds = (ranges or STAGE_RANGES).items()
    pick = lambda k, other: reduce(lambda c, x: F.when(stage == x[0], F.lit(float(x[1][k]))).otherwise(c), bounds, F.lit(other))
    start, end = pick(0, 0.0), pick(1, 100.0)
    return F.round(start + (end - start) * clamp(sub, 0.0, 100.0) / 100.0, 2)


def shown_percent(stage: Column, sub: Column, ranges: dict[str, tuple[float, float]] | None = None) -> Column:
    """overall_percent, but a finished job is at 100 and a failed one below it."""
    p = overall_percent(stage, sub, ranges)
    return F.when(stage == "done", F.lit(100.0)).when(stage == "failed", F.least(p, F.lit(99.99))).otherwise(p)


def zoom_percent(current: Column, least: Column, most: Column) -> Column:
    """Share of the zooms that are done, from the deepest on; null unless both bounds are known and differ."""
    span = most - least
    return F.when(span > 0, clamp((most - current) * 100.0 / span, 0.0, 100.0))


def elapsed_seconds(created: Column, completed: Column, status: Column, updated: Column, now: Column) -> Column:
    """Seconds that a job has taken; bad or missing timestamps count as missing, naive ones as UTC."""
    stamp = lambda c: F.try_to_timestamp(c)
    start = stamp(created)
    over = F.when(status.isin("completed", "failed"), F.coalesce(stamp(updated), start)).otherwise(stamp(now))
    micros = F.unix_micros(F.coalesce(stamp(completed), over)) - F.unix_micros(start)
    return F.when(micros.isNotNull(), F.round(F.greatest(micros, F.lit(0)) / 1e6, 3))


def flag_unsupported(log: Column) -> Column:
    """Whether a tool turned down its progress flag."""
    low = F.lower(log)
    return low.contains("unknown argument: -progress") | low.contains("unknown argument: --progress") | (low.contains("unknown option") & low.contains("progress"))


def normal_status(raw: Column) -> Column:
    """Blank is queued, unknown is running."""
    low = F.lower(strip(raw))
    return F.when(low.isNull() | (low == ""), F.lit("queued")).when(low.isin(*JOB_STATUSES), low).otherwise(F.lit("running"))


def stage_of_status(status: Column) -> Column:
    return reduce(lambda c, x: F.when(status == x[0], F.lit(x[1])).otherwise(c), STATUS_STAGES.items(), status)


def restored_progress(status: Column, error: Column) -> Column:
    """(percent, phase, message) of a job of which only the manifest is left."""
    percent = F.when(status == "completed", F.lit(100.0)).otherwise(F.lit(0.0))
    message = F.when(status == "completed", F.lit("Completed")).when(status == "failed", F.coalesce(F.nullif(error, F.lit("")), F.lit("Failed"))).when(status == "queued", F.lit("Queued")).otherwise(F.lit("Restored from disk"))
    phase = F.when(status == "completed", F.lit("done")).otherwise(status)
    return F.struct(percent.alias("percent"), phase.alias("phase"), message.alias("message"))


def step_weights(fill: Column, overviews: Column) -> Column:
    """Shares (reproject, fill, overview) of preprocessing."""
    f, o = F.when(fill, 0.15).otherwise(0.0), F.when(overviews, 0.15).otherwise(0.0)
    return F.struct((1.0 - f - o).alias("reproject"), f.alias("fill"), o.alias("overview"))


def step_percent(base: Column, sub: Column, weight: Column) -> Column:
    return F.least(base + sub * weight, F.lit(100.0))


def retry_millis(attempt: Column) -> Column:
    """Wait before the attempt-th reconnection, doubling up to 15 s."""
    return F.least(F.lit(15000), (F.pow(F.lit(2.0), attempt - 1) * 1000).cast("long")).cast("int")
