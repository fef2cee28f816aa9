"""factmill: code-fact analytics expressed as Spark DataFrame plans."""
