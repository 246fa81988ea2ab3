from larderline.functions.casting import (
    columns_at,
    number_of,
    numeric_columns,
    plain_id,
    present,
    to_int,
    to_number,
)
from larderline.functions.labels import first_label, label_of_rank, rank_of_label
from larderline.functions.ratios import pair_products, per_hundred, ratio, significant
from larderline.functions.text import keyword_pattern, matches_any

__all__ = [
    "columns_at",
    "first_label",
    "keyword_pattern",
    "label_of_rank",
    "matches_any",
    "number_of",
    "numeric_columns",
    "pair_products",
    "per_hundred",
    "plain_id",
    "present",
    "rank_of_label",
    "ratio",
    "significant",
    "to_int",
    "to_number",
]
