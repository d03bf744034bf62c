"""Column-level building blocks."""
from .missing import (clean_nan, drop_missing, exclude_codes, fill_missing_code, is_in,
                      not_equal, sum_columns)
from .numeric import n_round, safe_int
from .text import is_blank, natural_key, shown, strip

__all__ = ["clean_nan", "drop_missing", "exclude_codes", "fill_missing_code", "is_blank",
           "is_in", "n_round", "natural_key", "not_equal", "safe_int", "shown", "strip",
           "sum_columns"]
