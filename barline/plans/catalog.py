"""All registered queries."""

from barline.plans import aggs, books, flows, inference, joins, rows, rulesets, scans, windows  # noqa: F401
from barline.plans.registry import CHECKS, PLANS  # noqa: F401
