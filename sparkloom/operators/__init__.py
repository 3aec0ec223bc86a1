"""DataFrame operators: indexing, search, fusion, boosts, diversification, checks, metrics."""
