"""Longitudinal event detection and time-to-event analytics on Spark DataFrames."""

from fallpoint.contracts import SeriesError, series_problems, to_daily
from fallpoint.operators.detect import (detect_shift, detect_shift_batch, isolated_low_points, label_grid,
                                        recheck_without_low_points)
from fallpoint.operators.features import early_window_features, slope
from fallpoint.operators.grid import regularize, smooth
from fallpoint.operators.rates import interval_rates, label_table, rate_labels
from fallpoint.operators.risk import modelling_window, person_period
from fallpoint.plans.models import sampled_attribution
from fallpoint.plans.resample import leave_one_group_out, permutation_test

__version__ = "0.1.0"
__all__ = ["SeriesError", "series_problems", "to_daily", "detect_shift", "detect_shift_batch", "isolated_low_points",
           "label_grid", "recheck_without_low_points", "early_window_features", "slope", "regularize", "smooth",
           "interval_rates", "label_table", "rate_labels", "modelling_window", "person_period", "sampled_attribution",
           "leave_one_group_out", "permutation_test"]
