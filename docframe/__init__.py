"""docframe: DataFrame operators for paginated documents, cell grids, chart series and job events."""
