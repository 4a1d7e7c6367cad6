"""keyloom: keyed-data analytics as pure DataFrame operators on Spark."""
