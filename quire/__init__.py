"""quire: document text extraction, reflow and pagination as Spark relations."""
