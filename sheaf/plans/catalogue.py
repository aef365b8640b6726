"""All queries of the core and their oracle SQL."""

from __future__ import annotations

from sheaf.plans import deciding, dedups, joining, pages, pipeline, problems, repairs, rollups, texts

QUERIES = {**rollups.R.queries, **joining.R.queries, **dedups.R.queries, **deciding.R.queries, **texts.R.queries, **pages.R.queries, **repairs.R.queries, **pipeline.R.queries, **problems.QUERIES}
ORACLES = {**rollups.R.oracles, **joining.R.oracles, **dedups.R.oracles, **deciding.R.oracles, **texts.R.oracles, **pages.R.oracles, **repairs.R.oracles, **pipeline.R.oracles, **problems.ORACLES}
