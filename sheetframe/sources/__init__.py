"""File formats as pure-Python iterators, and the Spark sources over them."""
