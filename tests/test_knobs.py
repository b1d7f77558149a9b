"""Physical knobs never change a result."""

import numpy as np

from sigmaflow.config import TICK_PARAMS, ScaleKnobs
from sigmaflow.operators.acf import acf_panels
from sigmaflow.plans import evaluation as E
from sigmaflow.plans.inputs import TickInputs
from sigmaflow.plans.q_evaluation import STYLES_MAIN
from tests.conftest import SF_SMALL


def _result(spark, knobs):
    ctx = TickInputs(spark, SF_SMALL, knobs=knobs)
    fc = E.naive_forecasts(ctx.rv_all, ctx.rv_filtered_all, TICK_PARAMS)
    table = E.result_table(E.performance_data(fc, ctx.rv, ctx.sq, TICK_PARAMS), STYLES_MAIN).toPandas()
    acf = acf_panels({"5min": ctx.returns_5min}, "squared", knobs).toPandas()
    return (table.sort_values(["series", "proxy", "metric_rank"]).reset_index(drop=True),
            acf.sort_values(["series", "lag"]).reset_index(drop=True))


def test_knobs_do_not_change_results(spark):
    base_t, base_a = _result(spark, ScaleKnobs())
    odd_t, odd_a = _result(spark, ScaleKnobs(materialize=False, chunk_rows=17, median_buckets=4,
                                             median_max_candidates=25))
    assert len(base_t) == len(odd_t) > 0
    for c in ("five_min", "daily", "five_min_no_outlier"):
        assert np.allclose(base_t[c], odd_t[c], rtol=1e-9, equal_nan=True)
    assert np.allclose(base_a["acf"], odd_a["acf"], atol=1e-12)
