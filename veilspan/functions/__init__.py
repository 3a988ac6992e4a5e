"""Column builders: span scans, validators, text shapes."""
