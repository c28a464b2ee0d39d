"""All query modules, loaded once."""

from assayer.plans import gaps, modelling, profiles, series, statistics, tables  # noqa: F401
from assayer.plans.base import ORACLES, QUERIES  # noqa: F401
