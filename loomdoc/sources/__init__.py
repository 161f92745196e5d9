"""Tables of documents and media, on any file system that Spark knows."""
