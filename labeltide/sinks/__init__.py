"""Writers for splits, predictions, metric history and prediction lines."""
