from ledgerlight.functions.columns import (
    calendar_fields,
    categorical_columns,
    hash_bucket,
    is_blank,
    numeric_columns,
    parse_double,
    parse_long,
    period_label,
    strip,
)
from ledgerlight.functions.sums import exact_average, exact_sum

__all__ = [
    "calendar_fields",
    "categorical_columns",
    "exact_average",
    "exact_sum",
    "hash_bucket",
    "is_blank",
    "numeric_columns",
    "parse_double",
    "parse_long",
    "period_label",
    "strip",
]
