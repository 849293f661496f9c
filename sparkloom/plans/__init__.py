"""The registered queries."""

from . import contexts, corpus, numeric, ordered, ranged, stores, texts  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
