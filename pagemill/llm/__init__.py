"""Operators of a training-data pipeline over tables of documents, pages, vectors and conversations.

Nothing outside this folder imports it; ``catalog`` registers the queries.
"""
