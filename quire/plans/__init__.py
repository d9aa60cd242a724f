"""The queries over the reference's relations, by name, and their SQL."""

from . import book_queries, document_queries, page_queries, text_queries

QUERIES = {**text_queries.QUERIES, **page_queries.QUERIES, **book_queries.QUERIES, **document_queries.QUERIES}
ORACLE = {**text_queries.ORACLE, **page_queries.ORACLE, **book_queries.ORACLE, **document_queries.ORACLE}
