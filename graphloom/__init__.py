"""graphloom: property-graph analytics expressed as ordinary Spark DataFrame plans."""

__version__ = "0.1.0"
