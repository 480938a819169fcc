"""Writers and output projections."""
