"""Layered tables on PySpark from declarative specifications."""
