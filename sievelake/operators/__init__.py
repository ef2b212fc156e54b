"""Detections, joins, aggregations and orderings over findings."""
