"""granary: record and text analytics as lazy PySpark DataFrame plans."""
