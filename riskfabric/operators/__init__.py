"""DataFrame operators: recodes, place tables, imputation, ranking, metrics,
risk tables, lookups and model jobs."""
