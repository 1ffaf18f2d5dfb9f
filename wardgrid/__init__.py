"""wardgrid: patient-timeline analytics as plain Spark DataFrame functions."""
