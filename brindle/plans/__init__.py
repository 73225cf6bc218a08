"""The queries, by module; importing this registers all of them."""

from . import features, ingest, labelling, modelling, prices, reporting, resolution, scoring  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
