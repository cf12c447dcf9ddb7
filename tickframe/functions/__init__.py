from tickframe.functions.expr import (
    fixed_round,
    humanize_amount,
    ladder,
    month_name,
    pct_change,
    safe_div,
    safe_ln,
)

__all__ = ["fixed_round", "humanize_amount", "ladder", "month_name", "pct_change", "safe_div", "safe_ln"]
