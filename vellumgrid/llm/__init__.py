"""Training-data operators: deduplication, recognition, scoring, packing and segmentation over whole corpora."""
