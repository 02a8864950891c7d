"""cueforge: Spark-first analytics over timed tokens, intervals and media plans."""
