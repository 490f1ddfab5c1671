"""brindle: document search and analytics over typed nested collections, compiled to Spark plans."""
