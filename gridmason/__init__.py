"""gridmason: property-market analytics as Spark DataFrame plans."""
