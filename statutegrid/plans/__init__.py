"""Named queries over the supplied tables, with their SQL oracles."""
