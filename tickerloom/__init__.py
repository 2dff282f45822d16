"""Session-panel signals as Spark jobs: ingestion, vintages, signals, evaluation."""

__version__ = "0.1.0"
