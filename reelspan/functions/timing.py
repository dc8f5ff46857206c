"""Times and numbers as expressions: integer micro- or nanoseconds, half-even rounding, fallback chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: from here on (2000-01-01 UTC) nanoseconds count as absolute; smaller ones are relative to a boot.
ABSOLUTE_NS = 946_684_800_000_000_000
#: Playback rates in order, MP4 ticks of a second and of a lone frame, and units of sizes in powers of 1024.
RATES = (0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0)
TICKS, LONE_FRAME = 90_000, 3_000
UNITS = ("KB", "MB", "GB", "TB")


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def is_absolute(ns: Column) -> Column:
    """Whether nanoseconds are a date; false for null."""
    return F.coalesce(ns >= ABSOLUTE_NS, F.lit(False))


def iso_utc(ns: Column) -> Column:
    """ISO text of absolute nanoseconds to the millisecond, null for times relative to a boot."""
    text = F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=((ns - F.pmod(ns, F.lit(1_000_000))).cast("decimal(20,0)") / 1_000_000_000).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.when(is_absolute(ns), F.concat(text, F.lit("Z")))


def _hms(s: Column) -> Column:
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", F.floor(s / 3600).cast("string"), pad(F.floor(s / 60) % 60), pad(s % 60))


def clock(seconds: Column) -> Column:
    """h:mm:ss of seconds; a dash for null, NaN, negative ones and more than ten million."""
    usable = seconds.isNotNull() & ~F.isnan(seconds.cast("double")) & (seconds >= 0) & (seconds <= 10**7)
    return F.when(usable, _hms(F.floor(seconds).cast("long"))).otherwise("\u2014")


def position(ms: Column, millis: bool = False) -> Column:
    """mm:ss of milliseconds, h:mm:ss from an hour on, with the milliseconds if asked for; null and negative ones count as 0."""
    ms = F.greatest(F.coalesce(ms.cast("double"), F.lit(0.0)), F.lit(0.0))
    s = F.floor(ms / 1000).cast("long")
    text = F.when(s >= 3600, _hms(s)).otherwise(F.substring(F.concat(F.lit("0"), _hms(s)), 4, 5))
    return F.concat(text, F.lit("."), F.lpad(F.floor(ms % 1000).cast("string"), 3, "0")) if millis else text


def human_size(n: Column, places: int = 1, last: str = "TB") -> Column:
    """Bytes in B, KB, MB, GB or TB, no unit beyond `last`, with decimals from KB on. Ties round half-even, as in C; format_string alone would round them up."""
    units = UNITS[: UNITS.index(last) + 1]
    part = lambda power: F.concat(F.format_string(f"%.{places}f", F.bround(n / 1024.0**power, places)), F.lit(f" {units[power - 1]}"))
    out = part(len(units))
    for power in range(len(units) - 1, 0, -1):
        out = F.when(n < 1024 ** (power + 1), part(power)).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def clamp_rate(rate: Column) -> Column:
    """rate within RATES, to four places."""
    return F.bround(F.least(F.greatest(rate.cast("double"), F.lit(RATES[0])), F.lit(RATES[-1])), 4)


def next_rate(rate: Column, up: bool = True) -> Column:
    """The next of RATES, or the last one at the end."""
    further = F.filter(F.array(*map(F.lit, RATES)), lambda r: r > rate + 1e-9 if up else r < rate - 1e-9)
    return F.when(F.size(further) > 0, F.array_min(further) if up else F.array_max(further)).otherwise(F.lit(RATES[-1 if up else 0]))


def fit_width(width: Column, height: Column, most: int = 1280) -> tuple[Column, Column]:
    """Even width and height of at most `most` columns (0: any), in the picture's proportion."""
    even = lambda x: F.greatest(F.lit(2), x - x % 2)
    wide = (width > most) & F.lit(most > 0)
    return F.when(wide, even(F.lit(most))).otherwise(even(width)).cast("long"), F.when(wide, even(F.bround(height * most / width, 0).cast("long"))).otherwise(even(height)).cast("long")


def first_usable(*choices: tuple[Column, Column, str], default: tuple[Column, str]) -> tuple[Column, Column]:
    """Value and label of the first (usable, value, label) that is usable."""
    value, label = default[0], F.lit(default[1])
    for usable, v, name in reversed(choices):
        value, label = F.when(usable, v).otherwise(value), F.when(usable, F.lit(name)).otherwise(label)
    return value, label


def choose_timing(manual_fps: Column, payload_increasing: Column, log_increasing: Column, folder_fps: Column) -> tuple[Column, Column]:
    """fps (null: by stamps) and source of the timing: manual, payload stamps, log times, the folder's, 30."""
    none = F.lit(None).cast("double")
    manual = F.when(manual_fps == F.floor(manual_fps), "manual_integer").otherwise("manual_fraction")
    fps, source = first_usable(
        (F.coalesce(payload_increasing, F.lit(False)), none, "payload_timestamp"), (F.coalesce(log_increasing, F.lit(False)), none, "log_time"),
        (F.coalesce((folder_fps > 0) & (folder_fps <= TICKS), F.lit(False)), folder_fps, "session_json"), default=(F.lit(30.0), "default_30"),
    )
    return F.coalesce(manual_fps, fps), F.when(manual_fps.isNotNull(), manual).otherwise(source)


def ticks(delta: Column, per_second: int) -> Column:
    """Ticks of a duration, half-even, at least 1."""
    return F.greatest(F.lit(1), F.bround(delta.cast("decimal(20,0)") * TICKS / per_second, 0)).cast("long")
