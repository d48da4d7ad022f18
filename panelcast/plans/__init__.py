"""Ready-made panels over the sales tables, and the registered queries with their SQL twins."""
