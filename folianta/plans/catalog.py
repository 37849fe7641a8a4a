"""All registered queries and their SQL."""

from __future__ import annotations

from . import (  # noqa: F401
    check_queries,
    document_queries,
    format_queries,
    history_queries,
    image_queries,
    measure_queries,
    object_queries,
    record_queries,
    report_queries,
    run_queries,
    structure_queries,
    text_queries,
    view_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
