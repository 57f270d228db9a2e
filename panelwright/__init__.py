"""panelwright: Spark jobs for panels of daily market data and the tables around them."""

__version__ = "0.1.0"
