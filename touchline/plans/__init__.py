"""Named analytics: bindings, the catalog and the endpoint queries."""
