"""Column expressions and column-name rules. Nothing here starts a job."""

from panelcast.functions.expressions import (
    changepoint_features,
    days_since_epoch,
    dot,
    fourier_features,
    fourier_terms,
    hinge,
    missing_to_null,
    named,
    normal_cdf,
)
from panelcast.functions.names import feature_cols, matching, not_matching, variant_last

__all__ = [
    "changepoint_features",
    "days_since_epoch",
    "dot",
    "feature_cols",
    "fourier_features",
    "fourier_terms",
    "hinge",
    "matching",
    "missing_to_null",
    "named",
    "normal_cdf",
    "not_matching",
    "variant_last",
]
