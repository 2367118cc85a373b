from cohortline.functions.dates import month_start, parse_date_strict
from cohortline.functions.money import (cents_to_usd, mean_cents_to_usd, pct_1dp, round2_even,
                                        round_half_up, to_cents)
from cohortline.functions.text import strip_ws

__all__ = ["month_start", "parse_date_strict", "cents_to_usd",
           "mean_cents_to_usd", "pct_1dp", "round2_even", "round_half_up", "to_cents", "strip_ws"]
