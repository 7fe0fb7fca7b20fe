"""spanloom: text source retrieval and reuse detection as Spark DataFrame transformations."""
