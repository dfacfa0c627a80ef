"""Column functions: projections, codes, dates and display scales."""
