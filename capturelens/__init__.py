"""capturelens: Spark DataFrame operators for auditing image and sensor capture data."""

__version__ = "0.1.0"
