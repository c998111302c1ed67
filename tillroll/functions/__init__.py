"""Column expressions shared by the models; built-in Spark functions only."""
