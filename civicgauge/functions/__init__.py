"""Column builders: everything here returns a Spark ``Column`` made of built-in functions."""
# ruff: noqa: F401

from civicgauge.functions.codes import (
    KEEP, classify_tiers, crosswalk_band, first_rule, group_of, label_codes, pad_code, recode,
)
from civicgauge.functions.dates import active_in_window, duration_days, parse_date, quarter_label, year_of
from civicgauge.functions.numbers import (
    annualise, bin_to, excess_over_one, exact_mean, exact_sum, parse_money, percent_text, ratio, row_sum, share,
    to_number, word_weight,
)
from civicgauge.functions.records import bool_flag, normalise_bool, parse_object
from civicgauge.functions.text import (
    after_first, as_column, before_first, count_term, digits_only, expand_abbreviations, has_text, hit_flags, join_items,
    keep_characters, list_items, make_key, match_any, nth_piece, title_case,
)
