"""lodeglass: signal and evidence analytics over article collections, as Spark jobs."""
