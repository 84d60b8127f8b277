"""Named queries over the driver tables, one module per study."""
