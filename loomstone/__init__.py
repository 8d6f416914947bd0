"""loomstone: knowledge-collection analytics as Spark DataFrame plans."""
