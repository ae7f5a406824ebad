"""kashf: hybrid document retrieval, extractive answering and their analytics as PySpark plans."""
