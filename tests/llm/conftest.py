from corpora import documents, empty, odd, stored  # noqa: F401
