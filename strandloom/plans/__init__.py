"""Every query over the tables of a folder, except those of the training-data operators."""

from . import models, records, stability, variants  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
