"""DataFrame operators: metrics, periods, series, forest, blocking, matching, clusters, golden records."""
