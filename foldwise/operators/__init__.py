"""DataFrame -> DataFrame operators, grouped by the reference's data work."""
