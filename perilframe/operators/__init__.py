"""DataFrame -> DataFrame operators. Nothing here starts a session or returns rows to the driver
except where a docstring says so, and then only a result of fixed size."""
