"""Search, quantization, graph, layout and telemetry operators over DataFrames."""
