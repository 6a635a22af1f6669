"""Every query of the library outside the training-data subpackage, with its SQL."""

from __future__ import annotations

from plumbline.plans import curation, files, gates, ledgers, models, pools, records, sampling, scoring, similarity, statistics, text, upkeep, verdicts, versions, views
from plumbline.plans.catalog import ORACLES, QUERIES

FLAGSHIP = "flagship_leaderboard"
MODULES = (scoring, statistics, text, records, similarity, sampling, ledgers, views, versions, files, gates, curation, upkeep, models, pools, verdicts)

__all__ = ["FLAGSHIP", "MODULES", "ORACLES", "QUERIES"]
