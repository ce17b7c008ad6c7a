"""evenkeel: skew-aware partitioning and data preparation, expressed as Spark plans."""
