"""The grid algebra: areas, keys, projections, extents, merged ranges and styles over DataFrames."""
