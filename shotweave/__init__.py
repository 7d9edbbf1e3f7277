"""Timeline analytics (frames, shots, scenes, detections, metrics) as Spark DataFrame operators."""
