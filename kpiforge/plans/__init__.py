"""Query definitions over the driver tables (DataFrame compositions) and their SQL oracles."""
