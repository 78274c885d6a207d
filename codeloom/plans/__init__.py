

from . import queries  # noqa: F401
from . import more_queries  # noqa: F401  registers its queries
