"""Radio-network performance-counter analytics as PySpark DataFrame operators."""

from radiokpi.tables import Tables

__all__ = ["Tables"]
