"""Operations of a training-data pipeline: search, filters, deduplication, formatting, sharding, packing."""
