"""Queries by name, and the SQL that gives the same rows."""

from .plans import catalogue, context, domain, entities, identity, imports, involvement, ledgers, matching, more, parsers, providers, relational, reports, resolution
from .streaming import reviews, sessions

PLANS = (relational, domain, more, catalogue, identity, parsers, resolution, involvement, entities, ledgers, reports, imports, matching, context, providers, reviews, sessions)
QUERIES = {name: f for plan in PLANS for name, f in plan.QUERIES.items()}
ORACLES = {name: text for plan in PLANS for name, text in plan.ORACLES.items()}
FLAGSHIP = "dm1_scorecard"
