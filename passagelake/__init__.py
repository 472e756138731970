"""passagelake: document-grounded question answering and learning-platform analytics as Spark jobs."""

__version__ = "0.1.0"
