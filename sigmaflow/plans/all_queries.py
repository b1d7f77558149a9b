"""Import every query module so that the registry is complete."""

from sigmaflow.plans import q_evaluation, q_garch, q_models, q_tables, q_timeseries  # noqa: F401


def oracle() -> dict[str, str]:
    from sigmaflow.plans import oracle_models, oracle_sql, oracle_tables
    return {**oracle_sql.SQL, **oracle_models.SQL, **oracle_tables.SQL}
