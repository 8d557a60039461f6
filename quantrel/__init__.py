"""quantrel: statistics, metrics, features and models as Spark query plans."""
