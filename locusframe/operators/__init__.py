"""DataFrame transforms: selections, statistics, joins, clustering, tessellation, measurement."""
