"""Column builders: everything here returns a ``pyspark.sql.Column`` (or SQL text
for the same formula) and runs inside the JVM, without Python workers."""
