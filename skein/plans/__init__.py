"""Gates and typed measurements: what refuses instead of guessing."""
