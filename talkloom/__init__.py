"""talkloom: a PySpark engine for curating, scoring and analysing conversation corpora."""
