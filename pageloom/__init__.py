"""Web page captures to clean Markdown corpora, as Spark DataFrame jobs."""

__version__ = "0.1.0"
