"""The engine's named queries."""

from . import q_design, q_documents, q_export, q_joins, q_more, q_raster, q_scalar, q_search, q_video  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
