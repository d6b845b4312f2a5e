"""Reading files and request tables, writing manifests."""
