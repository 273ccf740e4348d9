"""Reading what may not be there."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

logger = logging.getLogger(__name__)


def if_found(read: Callable[[str], DataFrame], path: str | list[str]) -> DataFrame | None:
    """The table ``read`` makes of a path, or None and a warning where the path does not exist."""
    try:
        return read(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        logger.warning("not found: %s", path)
        return None
