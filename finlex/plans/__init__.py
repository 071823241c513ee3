"""Query plans: the registry of operator queries and their SQL oracles."""

from . import (  # noqa: F401
    q_bayes,
    q_end_to_end,
    q_explain,
    q_features,
    q_meta,
    q_misc,
    q_models,
    q_network,
    q_selection,
    q_stream,
    q_text,
)
from .registry import ORACLES, QUERIES  # noqa: F401
