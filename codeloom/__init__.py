"""codeloom: analytics over stores of source code knowledge, written as Spark DataFrame plans."""

__version__ = "0.1.0"
