"""Place for streaming operators. The capability set that this package rebuilds has none: no event
time, windows over time or incremental state. Coordinate histories are versioned batch tables
(``operators.sets.append_version``)."""
