"""DataFrame operators on the registry, feature and score tables."""
