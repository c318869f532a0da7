"""Jobs that chain operators and write lake layers."""
