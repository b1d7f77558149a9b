from sigmaflow.functions.columns import (  # noqa: F401
    day_of,
    epoch_to_ts,
    floor_bar,
    recode,
    round_doubles,
    ts_to_epoch,
)
from sigmaflow.functions.stats import normal_two_sided_p, t_two_sided_p  # noqa: F401
