"""DataFrame -> DataFrame operators: profile, clean, transform, chart, query, scan, udf."""
