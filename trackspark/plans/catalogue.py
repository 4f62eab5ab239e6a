"""All registered queries."""

from . import events, outline, pose, series, spectra, spines, states, streams, tables  # noqa: F401
from .registry import IDS, ORACLES, QUERIES  # noqa: F401
