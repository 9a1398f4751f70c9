"""Training-data operators: packing, token files, near-duplicates, search, secrets,
quality, HTML extraction and WARC. Nothing else in the library imports this package."""
