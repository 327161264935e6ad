"""Generic DataFrame operators: joins, reshaping, windows, quantiles, scoring, cohorts, analytics."""
