"""Import every plan module so that all queries are registered."""

from shopstream.plans import session_queries  # noqa: F401
from shopstream.plans import catalog_queries  # noqa: F401
from shopstream.plans import cart_queries  # noqa: F401
from shopstream.plans import model_queries  # noqa: F401
from shopstream.plans import extra_queries  # noqa: F401
from shopstream.plans import ingest_queries  # noqa: F401
