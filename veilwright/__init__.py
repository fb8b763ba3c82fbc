"""Detection, masking and audit of personal data in large document collections, on Spark."""

__version__ = "0.1.0"
