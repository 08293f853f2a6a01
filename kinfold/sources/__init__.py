"""Where inventories come from and where stage tables are kept."""
