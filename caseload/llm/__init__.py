"""Operations of a training-data pipeline: packing, filtering, deduplication, search, scans."""
