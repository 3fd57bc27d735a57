from estatescope.functions.scalars import (  # noqa: F401
    clock_text,
    column_count,
    datetime_text,
    default_literal,
    format_type,
    in_string_count,
    int_date,
    is_key,
    kind_code,
    kind_description,
    like_ci,
    major_version,
    name_key,
    pages_to_mb,
    percent_used,
    bytes_to_gb,
    regex_match,
    seconds_between,
    split_long_text,
    text_flag,
    thousands,
    whole_div,
)
from estatescope.functions.schedule import (  # noqa: F401
    frequency_name,
    schedule_description,
    unit_name,
)
