"""All registered queries, by family."""

from marketloom.catalog.base import ORACLE, QUERIES  # noqa: F401
from marketloom.catalog import (  # noqa: F401
    prices, news, quality, dashboard, stats, filings, panels, maintenance, streams, models,
)
