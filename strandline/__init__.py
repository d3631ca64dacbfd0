"""Web-archive analytics as Spark DataFrame operators.

Tables of pages, captures, links, crawl logs and job recipes go in, DataFrames
come out.  Everything is lazy except where an operator says otherwise.
"""

__version__ = "0.1.0"
