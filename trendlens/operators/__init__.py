"""DataFrame -> DataFrame operators: filters, joins, aggregates, top-N, brand lists."""
