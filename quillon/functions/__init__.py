"""SQL building blocks shared by the feature sets and metrics."""
