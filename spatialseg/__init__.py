"""spatialseg: spatial segmentation data processing as Spark DataFrame operators."""
