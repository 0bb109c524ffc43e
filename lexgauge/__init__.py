"""lexgauge: evaluation analytics for machine-generated text, expressed as Spark DataFrames."""

__version__ = "0.1.0"
