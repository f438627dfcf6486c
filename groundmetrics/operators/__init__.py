"""DataFrame operators: joins, sets, time series, scoring, aggregation, audit."""
