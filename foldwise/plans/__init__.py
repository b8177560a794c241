"""Plan-level helpers: sizing and join choices, lineage cuts, plan checks,
the driver tables and derived fixture views, and the registered queries."""
