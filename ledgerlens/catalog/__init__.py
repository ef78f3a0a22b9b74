"""All registered queries."""

from ledgerlens.catalog import ingest, layers, models, profiles, serving, streams, wallet_features  # noqa: F401
from ledgerlens.catalog.registry import REGISTRY
from ledgerlens.catalog.views import Views

__all__ = ["REGISTRY", "Views"]
