"""Operations of a training-data pipeline: each module is one operator, ``catalog`` registers their queries."""
