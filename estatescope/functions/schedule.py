"""Readable text for job schedules kept as integer codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from estatescope.functions import fixed_values as fv


def _lookup(code: Column, names: dict[int, str]) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))


def _clock(t: Column, pad_hour: bool) -> Column:
    """hhmmss number -> hour:minute; seconds are not shown."""
    digits = F.lpad(t.cast("string"), 6, "0")
    hour = F.substring(digits, 1, 2)
    if not pad_hour:
        hour = hour.cast("int").cast("string")
    return F.concat(hour, F.lit(":"), F.substring(digits, 3, 2))


def schedule_description(
    freq_type: Column, freq_interval: Column, freq_subday_type: Column,
    freq_subday_interval: Column, freq_relative_interval: Column,
    freq_recurrence_factor: Column, active_start_date: Column, active_end_date: Column,
    active_start_time: Column, active_end_time: Column,
) -> Column:
    """Text of a schedule; NULL for unknown codes."""
    interval = freq_interval.cast("int")
    every = F.concat(F.lit("Every "), freq_recurrence_factor.cast("string"))

    # Days of the week: bit n of the interval stands for the n-th name.
    chosen = F.filter(
        F.array(*[F.when(interval.bitwiseAND(1 << i) != 0, F.lit(d))
                  for i, d in enumerate(fv.WEEK_DAYS)]),
        lambda d: d.isNotNull())
    days = F.array_join(chosen, ", ")
    weekly = F.concat(every, F.lit(" week(s) on "),
                      F.when(days == "", "").otherwise(F.concat(days, F.lit(" "))))

    monthly = F.concat(every, F.lit(" months(s) on day "), interval.cast("string"),
                       F.lit(" of that month "))
    day_kind = _lookup(
        interval, {**{i + 1: d for i, d in enumerate(fv.WEEK_DAYS)}, **fv.RELATIVE_DAY_KINDS})
    relative = F.concat(every, F.lit(" months(s) on the "),
                        _lookup(freq_relative_interval, fv.RELATIVE_WEEKS), day_kind,
                        F.lit(" of that month "))

    day_part = (F.when(freq_type == 4, F.lit("Every day "))
                .when(freq_type == 8, weekly)
                .when(freq_type == 16, monthly)
                .when(freq_type == 32, relative))
    time_part = F.when(
        freq_subday_type == 1, F.concat(F.lit("at "), _clock(active_start_time, True))
    ).otherwise(
        F.concat(F.lit("every "), freq_subday_interval.cast("string"), F.lit(" "),
                 _lookup(freq_subday_type, fv.SUBDAY_UNITS), F.lit(" between "),
                 _clock(active_start_time, True), F.lit(" and "),
                 _clock(active_end_time, True)))

    return (
        F.when(freq_type == 1,
               F.concat(F.lit("Once on "), active_start_date.cast("string"), F.lit(" at "),
                        _clock(active_start_time, False)))
        .when(freq_type == 64, F.lit(fv.AUTO_START_LABEL))
        .when(freq_type == 128, F.lit(fv.ON_IDLE_LABEL))
        .otherwise(F.concat(day_part, time_part))
    )


def frequency_name(freq_type: Column, mode: str = "reference") -> Column:
    """Name of the frequency.  The agent-start name is only given in ``intended`` mode."""
    names = dict(fv.FREQUENCY_NAMES)
    if mode == "intended":
        names[64] = fv.AUTO_START_NAME
    return _lookup(freq_type, names)


def unit_name(freq_subday_type: Column) -> Column:
    return _lookup(freq_subday_type, fv.UNIT_NAMES)
