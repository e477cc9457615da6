"""Statement analytics as Spark plans: parsing, checks, metrics, dataset and evaluation operators."""

__version__ = "0.1.0"
