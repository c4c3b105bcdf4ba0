"""Column functions over traces: prices, time labels, text."""
