"""Document-intelligence and training-data jobs as plain ``DataFrame -> DataFrame`` functions."""
