"""All registered queries."""

from maskloom.plans import (  # noqa: F401
    corruption,
    draws,
    evaluation,
    metrics,
    order,
    scores,
    sources,
    streams,
    text,
    tokens,
)
from maskloom.plans.registry import QUERIES, SQL  # noqa: F401
