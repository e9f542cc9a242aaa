"""Protocol configurations, and the queries over the driver's tables with their SQL."""

from . import queries, episodes, manifests, traces, files  # noqa: F401, I001  each adds its queries
