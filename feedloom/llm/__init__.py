"""Training-data pipeline operators. Nothing else in feedloom imports this subpackage."""
