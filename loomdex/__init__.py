"""loomdex: analytics over large collections of interlinked artifacts, on PySpark."""

__version__ = "0.1.0"
