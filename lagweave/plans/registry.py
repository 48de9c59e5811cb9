"""All registered queries and their SQL."""

from __future__ import annotations

from . import cleaning, cohorts, evaluation, information, timeseries
from .base import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "cleaning", "cohorts", "evaluation", "information", "timeseries"]
FLAGSHIP = "rus_modalities"
