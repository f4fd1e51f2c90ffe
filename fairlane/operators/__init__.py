"""Relational operators: projections, filters, joins, aggregations, windows,
ordering and reshaping. All are DataFrame -> DataFrame and stay lazy."""
