"""Column → Column functions."""

from .numeric import (  # noqa: F401
    TRUE_WORDS, invert, join_notes, ratio, safe_float, step_score, to_bool, to_number,
    tri_state, zero_to_null,
)
from .rowwise import row_count, row_mean, row_sum, row_weighted_mean  # noqa: F401
from .stats import clip, normal_cdf, normal_cdf_sql, sigmoid100  # noqa: F401
from .text import (  # noqa: F401
    apply_map, clean_hangul, clean_web, collapse_repeats, contains_any, ensure_suffix,
    extract_region, keyword_regex, match_dictionary, norm_key, normalise_informal,
    prefix_key, regex_escape, squeeze, to_array,
)
