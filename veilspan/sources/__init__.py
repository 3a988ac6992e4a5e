"""Sources and sinks: word-processing packages, annotation files, reports."""
