"""lodestone: evidence retrieval and corpus preparation on PySpark DataFrames.

``sources``    readers and extractors (text, Markdown, HTML, PDF, landing folders)
``functions``  scalar expressions on columns
``operators``  relational, retrieval and measurement operators
``plans``      whole queries that combine operators
``streaming``  incremental ingestion with Structured Streaming
``llm``        training-data operators (imported by nothing else here)
"""
