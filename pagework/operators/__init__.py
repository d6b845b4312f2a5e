"""The page, metadata, image, search and validation operators. All take and return DataFrames."""
