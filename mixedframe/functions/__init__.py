from .normal import normal_quantile
from .scalars import (
    BLANK_TOKENS,
    blank_to,
    canonicalize,
    collapse_target,
    concat_label,
    fold_of,
    key_hash,
    log10_or_zero,
    nonzero_flag,
    recode,
    replace_first,
    round_half_even,
    safe_divide,
    year_of,
    years_in_service,
)
from .normal import CENTRE_DEN, CENTRE_NUM, MIDDLE_DEN, MIDDLE_NUM, TAIL_DEN, TAIL_NUM
