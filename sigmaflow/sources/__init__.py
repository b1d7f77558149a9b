from sigmaflow.sources.files import (  # noqa: F401
    RAW_PRICE_SCHEMA,
    read_raw_prices_csv,
    read_table,
    write_raw_prices_csv,
    write_table,
)
from sigmaflow.sources.tables import daily_prices, load, ticks  # noqa: F401
