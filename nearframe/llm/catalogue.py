"""All registered queries of this package."""

from . import queries  # noqa: F401
from .tables import QUERIES, SQL  # noqa: F401
