"""Training-data operators over a table of documents.

Nothing outside this subpackage imports it.  Every operator takes DataFrames,
reads the whole of each text, and leaves its large intermediates in the shared
folder named by ``spark.checkpoint.dir``.
"""
